"""Near-duplicate lines by an exact set-similarity join, in DataFrame operations only.

A line is the set of its words. Words are ordered by rarity, counted over all documents, and
two sets of Jaccard similarity ``4/5`` or more share a word among the first fifth of the larger
and the first ninth of the smaller one. Every set of words is kept once, at its earliest place,
and enters an index under the words of its prefix. Pairs that meet there pass a length filter, a
positional filter and a bound from 128 parity bits of the sets, and are then verified on their
words. A line with any earlier match is removed.

Keys are words with a size class: the power of two below the size of the smaller set. A set
enters its own class and, if it could be the larger set of a pair, the class below. Sets of one
pair also share two words if each prefix is taken one word longer. A key whose list would be long
is therefore split by each later word of the prefix: a pair that shares no other word as its first
still meets under its first two. Which keys these are decides the cost, never the result. Lists
without a line that could be the smaller set are left out, so lines from one template with few
words of their own do not meet in its words. A row of the index also holds the two words before
its own: lines that share one of those have met there, so that a pair is formed once for each run
of shared words, not once for each word.

Large groups of near copies make no quadratic output: in each list of the index a line is
first held against the list's first line and its own forerunner, and only lines that are not
clearly close to one of those meet the whole list. Lines for which that shortcut was not
confirmed meet the whole list afterwards.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearfield.llm.common import stored
from nearfield.sizing import broadcast_if_small, is_small

SLOT_BITS = 16
_SLOTS = 1 << SLOT_BITS
CROWD_BITS = 22  # slots in which the lengths of lists are counted
LONG = 256 * 256  # lines in a list, times those that could be the smaller set, from which a key is split by later words
Side = Callable[[str], Column]
PLACE = ["key", "tie", "line"]


def _identified(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key``, a 64-bit hash ``th`` of the text, and the text with all white space as spaces, in lower case.

    ``tie`` is that hash where a key has several texts, else 0: it orders and tells apart the same
    documents, and adds next to nothing to an index row.
    """
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    odd = reduce(or_, [F.contains(body, F.lit(c)) for c in "\t\x0b\f\r"])  # byte search, far cheaper than a pattern
    plain = F.when(odd, F.translate(body, "\t\x0b\f\r", "    ")).otherwise(body)
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.xxhash64(body).alias("th"), F.lower(plain).alias("text"))
    hashes = rows.groupBy("key").agg(F.min("th").alias("least"), F.max("th").alias("most"))
    shared = stored(hashes.where("least <> most").select(F.col("key").alias("of")), "shared-keys")
    if not is_small(shared):
        return rows.withColumn("tie", F.col("th"))
    tied = rows.join(F.broadcast(shared.withColumn("several", F.lit(True))), F.col("key").eqNullSafe(F.col("of")), "left")
    return tied.select("key", "th", "text", F.expr("if(several, th, 0L)").alias("tie"))


def _words(line: str) -> Column:
    return F.array_remove(F.split(line, " "), "")


def _lines(docs: DataFrame) -> DataFrame:
    """Every line with its words; its place is the document's key, the hash of the text among several of a key, and the line number."""
    lines = docs.select("key", "tie", F.posexplode(F.split("text", "\n")).alias("line", "words"))
    return lines.select(*PLACE, _words("words").alias("words"))


def _rarity(docs: DataFrame) -> Column:
    """A number per hash slot: the logarithm of how often words of that slot occur. The table has a fixed size."""
    word = docs.select(F.explode(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " ")).alias("word"))
    counts = word.groupBy(F.expr(f"xxhash64(word) & {_SLOTS - 1}").alias("slot")).agg(F.count(F.lit(1)).alias("n"))
    dense = docs.sparkSession.range(_SLOTS).withColumnRenamed("id", "slot").join(counts, "slot", "left")
    level = F.expr("least(127, cast(round(4 * log2(1 + coalesce(n, 0))) AS int))")
    listed = dense.select("slot", level.alias("level")).agg(F.expr("array_join(transform(array_sort(collect_list(struct(slot, level))), x -> cast(x.level AS string)), ',')"))
    return F.split(F.lit(listed.first()[0]), ",").cast("array<bigint>")


def _sets(docs: DataFrame) -> DataFrame:
    """Every distinct set of words at its earliest place: ``key, tie, line, n, low, high, prefix``."""
    levels = _rarity(docs)

    def token(code: Column) -> Column:
        return F.shiftleft(levels[code.bitwiseAND(_SLOTS - 1)], 56).bitwiseOR(code.bitwiseAND((1 << 56) - 1))

    lines = _lines(docs).where("size(words) > 0").select(*PLACE, F.sort_array(F.transform(F.array_distinct(F.transform("words", lambda w: F.xxhash64(w))), token)).alias("tokens"))
    # a bit of 128 for each word that is flipped by it: those of the lower half, and both halves on top of each other
    flipped = {"low": "if(t & 64 = 0, shiftleft(1L, cast(t & 63 AS int)), 0L)", "both": "shiftleft(1L, cast(t & 63 AS int))"}
    lines = lines.select("*", *[F.expr(f"aggregate(tokens, 0L, (a, t) -> a ^ {bit})").alias(name) for name, bit in flipped.items()])
    lines = lines.select(
        F.xxhash64("tokens").alias("s1"),
        F.xxhash64(F.lit(1), "tokens").alias("s2"),  # the seed in front: behind the tokens it would hash s1
        F.struct(
            *PLACE,
            F.size("tokens").alias("n"),
            "low",
            F.col("low").bitwiseXOR(F.col("both")).alias("high"),
            # one word more than a fifth; the order is that of the whole numbers, the index needs only their upper half
            F.expr("transform(slice(tokens, 1, size(tokens) - (4 * size(tokens) + 4) div 5 + 2), t -> cast(shiftright(t, 32) AS int))").alias("prefix"),
        ).alias("first"),
    )
    return lines.groupBy("s1", "s2").agg(F.min("first").alias("first")).select("first.*")


def _n(x: Side) -> Column:
    return F.shiftright(x("shape"), 32)


def _at(x: Side) -> Column:
    return F.shiftright(x("shape").bitwiseAND((1 << 32) - 1), 1)


def _smaller(x: Side) -> Column:
    """The line's key lies in the part of the prefix by which the smaller set of a pair is found."""
    return x("shape").bitwiseAND(1) == 1


def _near(x: Side, y: Side, quarters: int = 4) -> Column:
    """Sizes, places of the shared word and parity bits (or so many quarters of what they may differ) allow a similarity of 4/5."""
    nx, ny = _n(x), _n(y)
    # at most so many words are shared before the shared word, and from it on
    place = F.least(_at(x), _at(y)) + F.least(nx - _at(x), ny - _at(y))
    # a similarity of 4/5 is a ninth of the words of both that differ, or four ninths of them that are shared
    return (_apart(x, y) * 36 <= (nx + ny) * quarters) & (nx * 5 >= ny * 4) & (ny * 5 >= nx * 4) & (place * 9 >= (nx + ny) * 4)


def _met(x: Side, y: Side) -> Column:
    """Close enough, and found as a pair of a smaller and a larger set."""
    return _near(x, y) & ((_smaller(x) & (_n(x) <= _n(y))) | (_smaller(y) & (_n(y) <= _n(x)))) & ~_met_before(x, y)


def _met_before(x: Side, y: Side) -> Column:
    """Both have a word, one of the two before this row's, under which they are in one list as well."""
    before = [[F.shiftright(side("before"), 32), side("before").bitwiseAND((1 << 32) - 1)] for side in (x, y)]
    same = [(a == b) & (a != 0) for a in before[0] for b in before[1]]
    return same[0] | same[1] | same[2] | same[3]


def _apart(x: Side, y: Side) -> Column:
    return F.bit_count(x("low").bitwiseXOR(y("low"))) + F.bit_count(x("high").bitwiseXOR(y("high")))


def _side(alias: str, suffix: str = "") -> Side:
    return lambda name: F.col(f"{alias}.{name}{suffix}" if alias else f"{name}{suffix}")


def _place(side: Side, name: str) -> Column:
    return F.struct(*[side(c).alias(c) for c in PLACE]).alias(name)


_NINTH = "(n - (8 * n + 8) div 9 + 1)"


def _roles(sets: DataFrame) -> DataFrame:
    """A row per size class that a set enters, with the words ``reach`` by which it meets smaller sets of that class."""
    rows = sets.where("n IS NOT NULL AND low IS NOT NULL AND high IS NOT NULL").withColumn("own", F.expr("length(bin(n))"))
    rows = rows.withColumn("least", F.expr("shiftleft(1, own - 1)"))
    rows = rows.withColumn("class", F.explode(F.expr("if(5 * (least - 1) >= 4 * n, array(own, own - 1), array(own))")))
    smallest = "greatest((4 * n + 4) div 5, if(class = own, least, 0))"
    return rows.withColumn("reach", F.expr(f"cast(n - (4 * (n + {smallest}) + 8) div 9 + 1 AS int)")).drop("least")


def _words_of(roles: DataFrame) -> DataFrame:
    words = roles.select(*PLACE, "n", "low", "high", "own", "class", "reach", "prefix", F.posexplode("prefix").alias("at", "token"))
    return words.where("at < reach").withColumn("single", F.xxhash64("token", "class"))


def _crowded(sets: DataFrame) -> Column:
    """Whether the list of the key ``single`` is long, from one bit per hash slot. The table has a fixed size."""
    slot = F.expr(f"cast(single & {(1 << CROWD_BITS) - 1} AS int)").alias("slot")
    counts = _words_of(_roles(sets)).groupBy(slot).agg(F.count(F.lit(1)).alias("lines"), F.count_if(F.expr(f"class = own AND at < {_NINTH}")).alias("smaller"))
    long_ = counts.where(F.col("lines") * F.col("smaller") > LONG)
    bits = long_.groupBy(F.expr("shiftright(slot, 6)").cast("bigint").alias("word")).agg(F.expr("bit_or(shiftleft(1L, slot & 63))").alias("mask"))
    dense = sets.sparkSession.range(1 << CROWD_BITS - 6).withColumnRenamed("id", "word").join(bits, "word", "left")
    listed = dense.agg(F.expr("array_join(transform(array_sort(collect_list(struct(word, coalesce(mask, 0L) AS mask))), x -> cast(x.mask AS string)), ',')"))
    masks = F.split(F.lit(listed.first()[0]), ",").cast("array<bigint>")
    word = F.expr(f"cast(shiftright(single & {(1 << CROWD_BITS) - 1}, 6) AS int)")
    return masks[word].bitwiseAND(F.expr("shiftleft(1L, cast(single & 63 AS int))")) != 0


def _postings(sets: DataFrame, crowded: Column) -> DataFrame:
    """The index rows; the filters drop nothing, they make all uses of this table one plan, so that it is shuffled once.

    ``sig`` is the hash of a word and a size class, of a later word too where that list would be long;
    ``shape`` packs the size of the set, the place of the word and whether the row can stand for the
    smaller set of a pair. ``before`` packs the two words in front of the row's last word, 0 for none:
    with a later word those between the two, or, if there are none, those in front of the first. A word
    of the same number as the row's own counts as none, so that equal ones are always a list both are in.
    """
    words = _words_of(_roles(sets)).withColumn("later", F.when(crowded, F.expr("slice(prefix, at + 2, reach - at)")).otherwise(F.expr("array(cast(NULL AS int))")))
    keys = words.select(*PLACE, "n", "low", "high", "own", "class", "at", "token", "prefix", "single", F.posexplode("later").alias("k", "other"))
    # places of the last word in front of the row's last word, and of the first that may count
    keys = keys.withColumn("end", F.expr("if(k > 0, at + k, at - 1)")).withColumn("from", F.expr("if(k > 0, at + 1, 0)"))
    one, two = (F.expr(f"CASE WHEN `end` - {i} >= `from` AND get(prefix, `end` - {i}) <> token AND (other IS NULL OR get(prefix, `end` - {i}) <> other) THEN get(prefix, `end` - {i}) ELSE 0 END").cast("bigint") for i in (0, 1))
    smaller = F.expr(f"class = own AND at < {_NINTH} AND (other IS NULL OR at + k < {_NINTH})")
    shape = F.shiftleft(F.col("n").cast("bigint"), 32) + F.col("at") * 2 + smaller.cast("bigint")
    sig = F.when(F.col("other").isNull(), F.col("single")).otherwise(F.xxhash64("single", "other"))
    before = F.shiftleft(one, 32).bitwiseOR(two)
    return keys.select(sig.alias("sig"), *PLACE, "low", "high", shape.alias("shape"), before.alias("before")).where("sig IS NOT NULL AND shape IS NOT NULL")


def _other(x: Side, y: Side) -> Column:
    """Not the same line, which may stand twice in a list, as the index has the upper half of the words' numbers only."""
    return ~_place(x, "x").eqNullSafe(_place(y, "y"))


def _earlier() -> Column:
    return _place(_side("y"), "y") < _place(_side("x"), "x")


def _meetings(post: DataFrame) -> DataFrame:
    """Pairs ``x, y, short, far``: later ``x`` and earlier ``y`` through the shortcut, and, in lists where a line has none, all its others."""
    # windows over bare columns only: an expression would be computed below the shuffle, which the join could not share then
    order = Window.partitionBy("sig").orderBy(*PLACE)
    fields = [*PLACE, "low", "high", "shape"]
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # two frames: the list, evaluated once for it, and the row before; a third one with the rows so far would be evaluated for every row
    seen = post.withColumns({f"{c}_head": F.first(c).over(whole) for c in fields} | {f"{c}_last": F.lag(c).over(order) for c in fields} | {"used": F.bit_or("shape").over(whole)})
    own, head, last = _side(""), _side("", "_head"), _side("", "_last")
    seen = seen.where("shape_last IS NOT NULL AND used & 1 = 1")
    told = F.when(_near(own, head, 3) & _other(own, head), _told(own, head)).when(_near(own, last, 3) & _other(own, last), _told(own, last))
    seen = seen.select("sig", *fields, "before", told.alias("told")).alias("x")
    # one pass gives both: a line with a shortcut meets no one else here and stays as it is
    x, y = _side("x"), _side("y")
    met = seen.join(post.alias("y"), (x("sig") == y("sig")) & F.col("x.told").isNull() & _met(x, y) & _earlier(), "left")
    found = F.coalesce(F.col("x.told"), F.when(y("sig").isNotNull(), _told(x, y)))
    pairs = met.select(_place(x, "x"), found.alias("found"), F.col("x.told").isNotNull().alias("short"))
    return pairs.where("found IS NOT NULL").select("x", "found.y", "short", "found.far")


def _candidates(post: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs (later ``x``, earlier ``y``) through the shortcut, and all other pairs of lines without one, apart."""
    pairs = _meetings(post)
    return pairs.where("short").select("x", "y"), pairs.where("NOT short").select("x", "y")


def _told(x: Side, y: Side) -> Column:
    """The other line's place, and which part of the words of both the parity bits tell apart."""
    return F.struct(_place(y, "y"), (_apart(x, y) / (_n(x) + _n(y))).cast("float").alias("far"))


def _pair() -> list[Column]:
    return [_place(_side("x"), "x"), _place(_side("y"), "y")]


def _bodies(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """``place, body`` of the lines in pairs."""
    asked = broadcast_if_small(stored(pairs.select(F.col("x").alias("place")).union(pairs.select("y")).distinct(), "asked"))
    lines = docs.select("key", "tie", F.posexplode(F.split("text", "\n")).alias("line", "body"))
    lines = lines.select(F.struct(*PLACE).alias("place"), "body").join(asked, "place", "left_semi")
    return stored(lines.groupBy("place").agg(F.first("body").alias("body")), "bodies")


def _verified(bodies: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs whose sets of words have a similarity of 4/5 or more."""
    sides = pairs.join(bodies.select(F.col("place").alias("x"), F.col("body").alias("bx")), "x").join(bodies.select(F.col("place").alias("y"), F.col("body").alias("by")), "y")
    # the lines travel as text, which is far shorter than a list of words
    sides = sides.withColumns({"wx": F.array_distinct(_words("bx")), "wy": F.array_distinct(_words("by"))})
    common = F.size(F.array_intersect("wx", "wy"))
    return sides.where(common * 5 >= (F.size("wx") + F.size("wy") - common) * 4).select("x", "y")


def kept_lines(rows: DataFrame) -> DataFrame:
    """Places of the lines that stay, lines without words left out."""
    sets = stored(_sets(rows), "word-sets")
    crowded = _crowded(sets)
    post = _postings(sets, crowded)
    pairs = stored(_meetings(post).groupBy("x", "y").agg(F.max("short").alias("short"), F.min("far").alias("far")), "pairs")
    bodies = _bodies(rows, pairs)
    # One match is enough: first the closest pair, one of the shortcut before others, then, for lines it does not settle, all others.
    best = stored(pairs.groupBy("x").agg(F.min_by("y", F.struct(~F.col("short"), "far")).alias("y"), F.max("short").alias("short")), "best-pairs")
    found = stored(_verified(bodies, best.select("x", "y")).select("x"), "matched")
    open_ = stored(best.join(found, "x", "left_anti"), "unsettled")
    if not open_.isEmpty():
        others = pairs.select("x", "y").join(open_.select("x", F.col("y").alias("tried")), "x").where("y <> tried").select("x", "y")
        found = found.union(stored(_verified(bodies, others).select("x").distinct(), "matched"))
        unsure = stored(open_.where("short").select("x").join(found, "x", "left_anti"), "unsure")
        if not unsure.isEmpty():
            found = found.union(_again(rows, sets, crowded, post, unsure))
    return sets.select(F.struct(*PLACE).alias("x")).join(found, "x", "left_anti").select("x.*")


def _again(rows: DataFrame, sets: DataFrame, crowded: Column, post: DataFrame, unsure: DataFrame) -> DataFrame:
    """Lines whose shortcut was not confirmed, held against everything before them."""
    lines = sets.withColumn("place", F.struct(*PLACE)).join(broadcast_if_small(unsure.withColumnRenamed("x", "place")), "place", "left_semi").drop("place")
    asked = _postings(lines, crowded)
    pairs = broadcast_if_small(asked).alias("x").join(post.alias("y"), "sig").where(_met(_side("x"), _side("y")) & _earlier())
    pairs = stored(pairs.select(*_pair()).distinct(), "pairs-again")
    return _verified(_bodies(rows, pairs), pairs).select("x").distinct()


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """What stays of every document: ``key, th, n_lines, kept`` with the sorted numbers of the lines that stay.

    Lines end at line feeds and are numbered from 0. A line is removed if an earlier line, by
    document key (null first), then 64-bit hash ``th`` of the text, then number, has a similarity of
    4/5 or more to it, whether that one stays or not. Lines without words always stay. One row
    per input row; rows that repeat a key and its text are one document and all keep the same
    lines. A null or empty text is one line without words. Other columns are left out, so no
    name can clash.
    """
    rows = _identified(docs, key, text)
    stays = kept_lines(rows).groupBy("key", "tie").agg(F.collect_list("line").alias("worded"))
    blank = F.expr("filter(transform(split(text, '\\n'), (l, i) -> if(trim(l) = '', i, -1)), i -> i >= 0)")
    base = rows.select("key", "th", "tie", F.size(F.split("text", "\n")).alias("n_lines"), blank.alias("blank")).alias("d")
    joined = base.join(stays.alias("s"), F.col("d.key").eqNullSafe(F.col("s.key")) & (F.col("d.tie") == F.col("s.tie")), "left")
    kept = F.array_sort(F.concat("d.blank", F.coalesce("s.worded", F.array().cast("array<int>"))))
    return joined.select(F.col("d.key").alias(key), F.col("d.th").alias("th"), F.col("d.n_lines").alias("n_lines"), kept.alias("kept"))


def remove_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with the columns they had, their text without the removed lines; a text that loses nothing is unchanged, null included."""
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    fewer = stored(deduplicate(docs, key, text).where("size(kept) < n_lines").dropDuplicates([key, "th"]), "shortened")
    # only texts that lose lines are asked for; while those are few no text is shuffled
    fewer = broadcast_if_small(fewer.select(F.col(f"`{key}`").alias("__key"), F.col("th").alias("__th"), F.col("kept").alias("__kept")))
    joined = docs.withColumn("__hash", F.xxhash64(body)).join(fewer, F.col(f"`{key}`").eqNullSafe(F.col("__key")) & (F.col("__hash") == F.col("__th")), "left")
    once = F.array(F.struct(F.split(body, "\n").alias("lines"), F.col("__kept").alias("kept")))  # so that the text is split once, not once per line
    left = F.transform(once, lambda s: F.array_join(F.transform(s["kept"], lambda i: s["lines"][i]), "\n"))[0]
    joined = joined.withColumn(text, F.when(F.col("__kept").isNull(), F.col(f"`{text}`")).otherwise(left))
    return joined.select(*[f"`{c}`" for c in docs.columns])
