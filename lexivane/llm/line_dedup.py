"""Line deduplication with a segment-partition edit join, in DataFrame functions only.

A line that equals an earlier one, or lies within ``EDITS`` edits of one, is dropped; earlier means a smaller
doc_id, then an earlier place in the document. A line is split into EDITS + 1 segments. A shorter or equally long
line within EDITS edits has one of its segments somewhere in the longer line, near where it would stand, so the
substrings of these places probe an index of segments by number and line length. Pairs that meet are verified by a
banded bit-parallel edit distance.

With ``near_words``, lines within one word exchanged, added or dropped for every full ``WORDS`` words of the longer one
are near duplicates too. A line's runs of four or five words are put in the order of their hashes; its keys are the first
of them, as many as it takes until no allowed number of edits could change them all. Of two lines within the
edits, the one whose keys end first keeps a key that the other has among its own.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexivane.llm.common import stored

EDITS = 2
SHORTEST = 20
WORDS = 10
LONG_RUNS = 36
PLACE_BITS = 20
PLACES = (1 << PLACE_BITS) - 1


def join_keys(edits: int = EDITS) -> Column:
    """Keys of ``line`` with ``size`` letters: its own segments first, then what may be segments of other lines.

    Segment i of n letters starts at i * (n div parts), moved by the longer segments at the end. A substring may
    stand left or right of that place by the edits that the letters before and behind it can have.
    """
    parts = edits + 1
    own, other = [], []
    for shorter in range(edits + 1):
        n = f"(size - {shorter})"
        for i in range(parts):
            start = f"({n} div {parts} * {i} + greatest(0, {n} % {parts} - {parts - i}))"
            length = f"({n} div {parts} + if({n} % {parts} >= {parts - i}, 1, 0))"
            for shift in range(max(-i, shorter - (edits - i)), min(i, shorter + (edits - i)) + 1):
                key = f"xxhash64({i}, {n}, substring(line, cast({start} + {shift + 1} as int), cast({length} as int)))"
                (own if shorter == 0 and shift == 0 else other).append(key)
    return F.expr(f"array({', '.join(own + other)})")


def shared_prefix(a: Column, b: Column) -> Column:
    """Length of the common prefix, by bisection."""
    most = F.least(F.length(a), F.length(b))
    steps = F.sequence(F.lit(1), F.ceil(F.log2(F.greatest(most, F.lit(1)) + 1)).cast("int") + 1)

    def narrow(state: Column, _: Column) -> Column:
        middle = F.floor((state["lo"] + state["hi"] + 1) / 2).cast("int")
        same = F.substring(a, F.lit(1), middle) == F.substring(b, F.lit(1), middle)
        return F.struct(F.when(same, middle).otherwise(state["lo"]).alias("lo"), F.when(same, state["hi"]).otherwise(middle - 1).alias("hi"))

    return F.aggregate(steps, F.struct(F.lit(0).alias("lo"), most.alias("hi")), narrow)["lo"]


def band_after(of_a: Column, of_b: Column, edits: int = EDITS) -> Column:
    """Bit-parallel edit distance along the diagonals, for arrays of letters: the bits after all of ``b``.

    After j letters of ``b``, bit k of the number for e edits tells whether the first j - edits + k letters of ``a``
    can be turned into them with e edits. 2 * edits + 1 bits hold all diagonals that matter.
    """
    band = (1 << (2 * edits + 1)) - 1
    start = F.struct(*[F.lit(sum(1 << (edits + k) for k in range(e + 1)) & band).alias(f"e{e}") for e in range(edits + 1)])

    def step(state: Column, letter: Column, j: Column) -> Column:
        met = None
        for k in range(2 * edits + 1):
            at = j - edits + k
            bit = F.when((at >= 0) & (F.get(of_a, F.greatest(at, F.lit(0))) == letter), F.lit(1 << k)).otherwise(F.lit(0))
            met = bit if met is None else met.bitwiseOR(bit)
        new: list[Column] = []
        for e in range(edits + 1):
            now = state[f"e{e}"].bitwiseAND(met)
            if e:
                less = state[f"e{e - 1}"]
                now = now.bitwiseOR(less).bitwiseOR(F.shiftright(less, 1)).bitwiseOR(F.shiftleft(new[-1], 1)).bitwiseAND(F.lit(band))
            new.append(now)
        return F.when(state[f"e{edits}"] == 0, state).otherwise(F.struct(*[x.alias(f"e{e}") for e, x in enumerate(new)]))

    numbered = F.transform(of_b, lambda x, j: F.struct(x.alias("x"), j.alias("j")))
    return F.aggregate(numbered, start, lambda state, x: step(state, x["x"], x["j"]))


def distance_from(band: Column, size_a: Column, size_b: Column, edits: int = EDITS) -> Column:
    """Edit distance that the bits tell, or null if it is over ``edits``."""
    bit = size_a - size_b + edits
    reached = [F.when(F.pmod(F.floor(band[f"e{e}"] / F.pow(F.lit(2.0), bit)), F.lit(2)) == 1, F.lit(e)) for e in range(edits + 1)]
    return F.when((bit >= 0) & (bit <= 2 * edits), F.coalesce(*reached))


def letters(text: Column) -> Column:
    return F.when(F.length(text) > 0, F.split(text, "")).otherwise(F.array().cast("array<string>"))


def letter_parity(of: Column) -> Column:
    """64 bits: which (hashed) letters occur an odd number of times. An edit turns two bits at most."""
    return F.aggregate(of, F.lit(0).cast("long"), lambda bits, x: bits.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.hash(x), F.lit(64)))))


def pair_parity(of: Column) -> Column:
    """64 bits: which (hashed) pairs of neighbouring letters occur an odd number of times. An edit turns four bits at most."""
    start = F.struct(F.lit(0).cast("long").alias("bits"), F.lit("").alias("before"))
    turn = lambda state, x: state["bits"].bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.hash(state["before"], x), F.lit(64))))
    return F.aggregate(of, start, lambda state, x: F.struct(turn(state, x).alias("bits"), x.alias("before")))["bits"]


def lines_of(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """One row per line: doc_id, print (of the text), pos, line."""
    slim = df.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("print"), F.col(text).alias("text"))
    return slim.where("text is not null").select("doc_id", "print", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))


def words_of(line: Column) -> Column:
    """The words between white space. A line without any has one, the empty text."""
    # a text is split at single spaces several times faster than by a pattern, so only lines with other white space are rewritten
    other = [line.contains(c) for c in ("  ", "\t", "\n", "\x0b", "\f", "\r")]
    spaced = F.when(reduce(or_, other), F.regexp_replace(line, r"\s+", " ")).otherwise(line)
    return F.split(F.trim(spaced), " ")


def picked_runs(q: int) -> Column:
    """How many of ``runs``, of ``q`` words each and in the order of their first words, ``n div (WORDS - 1)`` edits cannot change whole.

    ``runs`` are sorted longs, a place in the lowest PLACE_BITS bits and the hash of the first word above. An edit changes the runs
    that cover one place, so the fewest edits that change some runs are found by going through them from left to right, with their number
    above the next free place in one long. Parts of growing size are tried; the last one, q runs for each edit and one, always does.
    """
    edits = f"(n div {WORDS - 1})"
    several = [f"cast(ceil(1.5 * ({edits} + 1)) as int)", f"2 * ({edits} + 1)", f"3 * ({edits} + 1)"]
    places = lambda m: f"sort_array(transform(slice(runs, 1, {m}), r -> r & {PLACES}L))"
    walked = lambda m: f"aggregate({places(m)}, 0L, (s, p) -> if(p < (s & 4294967295L), s, (s | 4294967295L) + p + {q + 1}L))"
    tried = " ".join(f"when shiftright({walked(m)}, 32) > {edits} then {m}" for m in several)
    return F.expr(f"least(size(runs), case {tried} else {q} * {edits} + 1 end)")


def with_word_keys(df: DataFrame) -> DataFrame:
    """``df(words, ...)`` with ``word_keys``, none for lines of fewer than WORDS - 1 words.

    Runs have five words in lines of ``LONG_RUNS`` words and more, else four. A longer line whose partners may be below
    that has keys of both kinds. Runs are ordered by their first words, and only the picked ones are hashed; those that begin with the same word
    as the last one picked are keys too, so that the order of such runs does not matter. A line with more places than fit has all runs as keys.
    """
    sized = df.withColumn("n", F.size("words"))
    none = F.array().cast("array<bigint>")
    for q, wanted in ((4, f"n >= {WORDS - 1} and n - n div {WORDS} < {LONG_RUNS}"), (5, f"n >= {LONG_RUNS}")):
        starts = f"slice(words, 1, n - {q - 1})"
        run = lambda at: f"xxhash64({q}, slice(words, cast({at} as int) + 1, {q})) & {~PLACES}L"  # noqa: B023, E731
        sized = sized.withColumn("runs", F.expr(f"case when {wanted} and n <= {PLACES} then sort_array(transform({starts}, (w, i) -> xxhash64(w) & {~PLACES}L | i)) end"))
        sized = sized.withColumn("picked", F.when(F.col("runs").isNotNull(), picked_runs(q)))
        # get() counts from 0: the last picked run and the one behind it
        last, behind = "get(runs, picked - 1)", "get(runs, picked)"
        tied = f"{behind} <= ({last} | {PLACES}L)"
        sized = sized.withColumn("runs", F.expr(f"case when picked is null then null when {tied} then filter(runs, r -> r <= ({last} | {PLACES}L)) else slice(runs, 1, picked) end"))
        keys = f"case when runs is not null then transform(runs, r -> {run(f'(r & {PLACES}L)')}) when {wanted} then transform({starts}, (w, i) -> {run('i')}) end"
        sized = sized.withColumn(f"keys_{q}", F.coalesce(F.array_distinct(F.expr(keys)), none))
    return sized.withColumn("word_keys", F.concat("keys_4", "keys_5")).drop("runs", "picked", "keys_4", "keys_5")


def word_parity(words: str) -> Column:
    """Four longs: which (hashed) words occur an odd number of times. An edit turns two bits of them at most."""
    part = lambda k: f"aggregate(filter({words}, w -> (w & 768L) = {k << 8}L), 0L, (bits, w) -> bits ^ shiftleft(1L, cast(w & 63L as int)))"
    return F.expr(f"array({', '.join(map(part, range(4)))})")


def as_letters(words: Column, shift: int) -> Column:
    """A letter for each word, so that letters' distance is the words'; 20 bits of the hash from ``shift`` on choose it, ten for each surrogate."""
    code = lambda x: F.hex(F.shiftright(x, shift).bitwiseAND(F.lit(0x03FF03FF)).bitwiseOR(F.lit(0xD800DC00)))
    return F.decode(F.unhex(F.array_join(F.transform(words, code), "")), "UTF-16BE")


SPELLED = ("n", "bits", "x", "y")


def with_spelled(df: DataFrame) -> DataFrame:
    """``df(words, ...)`` with columns SPELLED for ``words``: their number, their parities and two texts with a letter for each of them. Null words have none."""
    words = F.col("words")
    of_words = (F.size(words), word_parity("words"), as_letters(words, 0), as_letters(words, 32))
    return df.withColumns({name: F.when(words.isNotNull(), c) for name, c in zip(SPELLED, of_words)}).drop("words")


def near_by_words(met: DataFrame, lines: DataFrame) -> DataFrame:
    """``h`` of the lines that lie within one edit of words for each ten of the longer one's of an earlier line with a key of ``met(h, key)`` in common.

    ``lines`` has h, first (its place) and SPELLED. A line needs one such partner, not all of them. So every line is compared
    with the first line of each of its keys, and only lines without a partner among these with the other lines of their keys,
    in semi-joins, which stop at the first one. No step makes more rows than lines have keys.
    """
    bits = [F.col("bits")[k].alias(f"bits{k}") for k in range(4)]
    signs = met.join(lines.select("h", "first", "n", *bits), "h")
    slim = ["h", "first", "n", *[f"bits{k}" for k in range(4)]]
    by_key = Window.partitionBy("key")
    lead = F.min(F.struct("first", "h", "n", *[f"bits{k}" for k in range(4)])).over(by_key)

    def edits(a: str, b: str) -> str:
        return f"cast(greatest({a}n, {b}n) div {WORDS} as int)"

    def alike(a: str, b: str) -> str:
        apart = " + ".join(f"bit_count({a}bits{k} ^ {b}bits{k})" for k in range(4))
        return f"abs({a}n - {b}n) <= {edits(a, b)} and {apart} <= 2 * {edits(a, b)}"

    def near(a: str, b: str) -> str:
        return f"levenshtein({a}x, {b}x, {edits(a, b)}) >= 0 and levenshtein({a}y, {b}y, {edits(a, b)}) >= 0"

    led = signs.select("key", *slim, lead.alias("lead"), F.count("*").over(by_key).alias("lines")).where("lead.h <> h")
    signs = stored(led.select("key", *slim, "lines", F.col("lead.h").alias("lead"), F.expr(alike("lead.", "")).alias("alike")), "lines-word-bits")
    pairs = stored(signs.where("alike").select(F.col("lead").alias("a"), F.col("h").alias("b")).distinct(), "lines-word-pairs")
    side = lambda s: lines.where("x is not null").select(F.col("h").alias(s), F.struct("n", "x", "y").alias(f"of_{s}"))
    led_near = stored(pairs.join(side("a"), "a").join(side("b"), "b").where(near("of_a.", "of_b.")).select(F.col("b").alias("h")).distinct(), "lines-word-near")

    # first lines of a key are not in signs: they have no earlier partner there, and were compared as partners; two lines of a key have no others
    signs = signs.where("lines > 2")
    rest = signs.join(led_near, "h", "left_anti").select("key", *slim).alias("b")
    earlier = (F.col("a.key") == F.col("b.key")) & F.expr(f"a.first < b.first and {alike('a.', 'b.')}")
    open_ = stored(rest.join(signs.alias("a"), earlier, "left_semi"), "lines-word-open")
    partners = signs.select("key", *slim).join(open_.select("key").distinct(), "key", "left_semi")
    texts = lines.where("x is not null").select("h", "x", "y")
    whole = earlier & F.expr(near("a.", "b."))
    rest_near = stored(open_.join(texts, "h").alias("b").join(partners.join(texts, "h").alias("a"), whole, "left_semi").select("h").distinct(), "lines-word-rest")
    return led_near.unionByName(rest_near)


def met_keys(keyed: DataFrame, edits: int) -> DataFrame:
    """``h, key, kind`` of the keys of ``keyed(h, n, keys, word_keys)`` that several lines share; kinds: 0 a substring that may be a segment, 1 a segment, else a run of words and the ``n`` words of its line.

    A run of words counts if another line with it has so many words that the longer one's edits allow for the difference; of
    the lines with more words, and of those with fewer, the nearest is the likeliest.
    """
    kind = F.when(F.col("at") >= F.col("n_keys"), F.col("n")).when(F.col("at") <= edits, 1).otherwise(0)
    keys = keyed.select("h", "n", F.size("keys").alias("n_keys"), F.posexplode(F.concat("keys", "word_keys")).alias("at", "key")).select("h", "key", kind.alias("kind"))
    by_key = Window.partitionBy("key")
    met = keys.select("h", "key", "kind", F.min("h").over(by_key).alias("lo"), F.max("h").over(by_key).alias("hi"), F.max("kind").over(by_key).alias("most"))
    # few rows are left for the second window, which needs no further shuffle
    by_size = by_key.orderBy("kind")
    met = met.where("lo <> hi and most > 0").select("h", "key", "kind", F.lag("kind").over(by_size).alias("below"), F.lead("kind").over(by_size).alias("above"))
    return met.where(f"kind < 2 or coalesce(kind - below <= kind div {WORDS}, false) or coalesce(above - kind <= above div {WORDS}, false)").select("h", "key", "kind")


def dropped_lines(df: DataFrame, doc_id: str = "doc_id", text: str = "text", edits: int = EDITS, shortest: int = SHORTEST, short_repeats: bool = False, near_words: bool = False) -> DataFrame:
    """doc_id, print (hash of the whole text) and the places of the lines to drop, for documents that lose any.

    Lines of fewer than ``shortest`` characters, at least three for each segment, stay; with ``short_repeats`` they go where
    they equal an earlier line, unless they are blank. ``near_words`` compares words as well. Rows with equal doc_id and text are one document. A null doc_id comes
    before all others.
    """
    if shortest < 3 * (edits + 1):
        raise ValueError("lines must be long enough to be split")
    long_enough = F.col("size") >= shortest
    wanted_lines = long_enough | F.col("line").rlike(r"\S") if short_repeats else long_enough
    lines = lines_of(df, doc_id, text).withColumn("size", F.length("line")).where(wanted_lines)
    marked = lines.select("doc_id", "print", "pos", F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("h2"), "line")
    groups = marked.select("h", "h2", F.struct("doc_id", "print", "pos").alias("place"), "line").groupBy("h", "h2")
    groups = stored(groups.agg(F.min("place").alias("first"), F.count("*").alias("times"), F.first("line").alias("line")), "lines-distinct")
    none = F.array().cast("array<bigint>")
    keyed = groups.select("h", "line", F.length("line").alias("size")).where(long_enough)
    if near_words:
        # an edit of letters is two of words at most, so lines with enough words meet such partners by words
        keyed = with_word_keys(keyed.withColumn("words", words_of(F.col("line"))))
        keys = F.when(F.col("n") < 2 * edits * WORDS, join_keys(edits)).otherwise(none)
    else:
        keyed, keys = keyed.withColumn("word_keys", none).withColumn("n", F.lit(0)), join_keys(edits)
    met = stored(met_keys(keyed.select("h", "n", "word_keys", keys.alias("keys")), edits), "lines-met")
    # what met by letters is kept as a line, what met by words as letters for them
    wanted = met.groupBy("h").agg(F.bool_or(F.col("kind") < 2).alias("by_letters"), F.bool_or(F.col("kind") >= 2).alias("by_words"))
    found = groups.select("h", "h2", "first", "line").join(wanted.hint("shuffle_hash"), "h")
    kept = [F.when(F.col("by_letters"), F.col("line")).alias("line"), F.when(F.col("by_words"), F.transform(words_of(F.col("line")), lambda w: F.xxhash64(w))).alias("words")]
    found = found.select("h", "h2", "first", *kept)
    found = stored(with_spelled(found) if near_words else found.drop("words"), "lines-text")

    # lines that share a segment meet only if their letters, and pairs of letters, can be within the edits
    by_segment = met.where("kind < 2")
    parity = found.where("line is not null").withColumn("of", letters(F.col("line"))).select("h", letter_parity(F.col("of")).alias("ones"), pair_parity(F.col("of")).alias("twos"))
    signed = stored(by_segment.withColumn("own", F.col("kind") == 1).join(parity.groupBy("h").agg(F.first("ones").alias("ones"), F.first("twos").alias("twos"), F.count("*").alias("lines")), "h"), "lines-signed")
    short = signed.where("own").select("key", F.col("h").alias("a"), F.col("ones").alias("ones_a"), F.col("twos").alias("twos_a"), F.col("lines").alias("lines_a"))
    long = signed.select("key", F.col("h").alias("b"), F.col("ones").alias("ones_b"), F.col("twos").alias("twos_b"), F.col("lines").alias("lines_b"))
    alike = F.expr(f"a <> b and (lines_a > 1 or lines_b > 1 or bit_count(ones_a ^ ones_b) <= {2 * edits} and bit_count(twos_a ^ twos_b) <= {4 * edits})")
    pairs = stored(short.join(long, "key").where(alike).select("a", "b").distinct(), "lines-pairs")

    side = lambda s: found.select(F.col("h").alias(s), F.col("h2").alias(f"{s}2"), F.col("first").alias(f"first_{s}"), F.col("line").alias(f"line_{s}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    cut = both.withColumn("same", shared_prefix(F.col("line_a"), F.col("line_b")))
    tails = {s: F.reverse(F.expr(f"substring(line_{s}, same + 1)")) for s in ("a", "b")}
    cut = cut.withColumns({"tail_a": tails["a"], "tail_b": tails["b"]}).withColumn("end", shared_prefix(F.col("tail_a"), F.col("tail_b")))
    cut = cut.withColumns({"mid_a": F.expr("substring(tail_a, end + 1)"), "mid_b": F.expr("substring(tail_b, end + 1)")})
    # written before it is filtered, else the optimizer would copy the nested columns into the condition
    measured = cut.withColumns({"of_a": letters(F.col("mid_a")), "of_b": letters(F.col("mid_b"))}).withColumn("band", band_after(F.col("of_a"), F.col("of_b"), edits))
    measured = measured.withColumn("edits", distance_from(F.col("band"), F.size("of_a"), F.size("of_b"), edits)).select("a", "a2", "first_a", "b", "b2", "first_b", "edits")
    later_one = F.when(F.col("first_a") > F.col("first_b"), F.struct(F.col("a").alias("h"), F.col("a2").alias("h2"))).otherwise(F.struct(F.col("b").alias("h"), F.col("b2").alias("h2"))).alias("x")
    later = stored(measured, "lines-measured").where("edits is not null").select(later_one)
    near_lines = later.select("x.*")
    if near_words:
        runs = met.where("kind >= 2").select("h", "key")
        near = near_by_words(runs, found.where("x is not null").select("h", "first", *SPELLED))
        near_lines = near_lines.unionByName(near.join(found.select("h", "h2"), "h").select("h", "h2"))
    near_lines = near_lines.distinct().withColumn("near", F.lit(True))

    repeated = groups.select("h", "h2", "first", "times").join(near_lines, ["h", "h2"], "left").where("near or times > 1")
    hits = marked.select("doc_id", "print", "pos", "h", "h2").join(repeated, ["h", "h2"])
    here = F.struct("doc_id", "print", "pos")
    out = hits.where(F.col("near").isNotNull() | ~here.eqNullSafe(F.col("first"))).select("doc_id", "print", "pos").distinct()
    return out.groupBy("doc_id", "print").agg(F.sort_array(F.collect_list("pos")).alias("dropped"))


def report(df: DataFrame, doc_id: str = "doc_id", text: str = "text", **options: bool) -> DataFrame:
    """One row per document: doc_id, n_lines, n_dropped, dropped (places of the dropped lines from 0).

    A null text has no lines; an empty one has one, which stays. Repeated rows are each reported. ``options`` go to ``dropped_lines``.
    """
    gone = stored(dropped_lines(df, doc_id, text, **options), "lines-dropped").select(F.col("doc_id").alias("of"), F.col("print").alias("of_print"), "dropped")
    docs = df.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("print"), F.coalesce(F.size(F.split(text, "\n", -1)), F.lit(0)).alias("n_lines"))
    docs = docs.join(gone, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("print") == F.col("of_print")), "left")
    none = F.array().cast("array<int>")
    return docs.select("doc_id", F.when(F.col("n_lines") > 0, F.col("n_lines")).otherwise(0).alias("n_lines"), F.coalesce(F.size("dropped"), F.lit(0)).alias("n_dropped"), F.coalesce("dropped", none).alias("dropped"))


def deduplicated(df: DataFrame, doc_id: str = "doc_id", text: str = "text", n_chars: str = "n_chars", **options: bool) -> DataFrame:
    """The documents without the dropped lines, columns as they were; ``n_chars``, if there, is counted anew.

    Documents that keep no line with a visible character go if they lost one; all others stay, null texts too.
    ``options`` go to ``dropped_lines``.
    """
    gone = stored(dropped_lines(df, doc_id, text, **options), "lines-dropped").select(F.col("doc_id").alias("__of"), F.col("print").alias("__print"), F.col("dropped").alias("__dropped"))
    columns = df.columns
    met = df.join(gone, df[doc_id].eqNullSafe(F.col("__of")) & (F.xxhash64(df[text]) == F.col("__print")), "left")
    kept = F.array_join(F.filter(F.split(text, "\n", -1), lambda _, i: ~F.array_contains(F.col("__dropped"), i)), "\n")
    met = met.withColumn("__kept", F.when(F.col("__dropped").isNull(), F.col(text)).otherwise(kept))
    met = met.where(F.col("__dropped").isNull() | F.col("__kept").rlike(r"\S"))
    changed = {text: F.col("__kept")} | ({n_chars: F.length("__kept").cast(df.schema[n_chars].dataType)} if n_chars in columns else {})
    return met.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in columns])
