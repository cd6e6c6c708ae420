"""Fuzzy line dedup by MinHash, all of it DataFrame operations and built-in functions.

1. A line is the set of its character shingles, windows of eight characters, hashed.
2. For banding a line of few words is its shingles, one of many words its pairs of neighbouring words, a sample of places
   that depends on content alone; lines of a middle number of words are both, so two similar lines have one form in common. The smallest
   hashes in order are the MinHash signature.
3. Banding: each run of four consecutive signature values is a band, where a run starts at one of the first
   values or at a value divisible by four (in lines of few shingles: by two). Runs are compared by content, not by number,
   so an inserted shingle breaks only the runs around it. A run is whole: one that the signature's end cuts off would be
   the band of all lines with one common shingle. Of lines of similarity 0.75 about 2 % share no band (pairs of words: up to 3.5 %,
   when letters change), of more similar ones hardly any.
4. A band's smallest line is its hub. A line is compared with one hub, the smallest of its bands', by the exact Jaccard
   similarity of the whole shingle sets, and distributed union-find forms components. Lines outside the largest
   component of a band then try a few lines of it. Only of bands that still hold several components all lines are compared that
   were not yet, a few against all others in a round, until each band's lines are in one component or all compared.
5. Of each component one line stays, the first by document id and line number.

Equal lines share one id from the start. Bands are combined before every exchange, so a line that
makes up a third of the corpus costs a row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourweave.llm.components import connected
from hourweave.llm.expressions import held, let
from hourweave.llm.scratch import settled, written
from hourweave.llm.sketches import _CHUNK, _long_signature, hashed, runs, shingle_set, signatures  # noqa: F401

#: Characters of a shingle.
SHINGLE = 8
#: Values of a signature, values of a run, and starts that need no divisibility.
SIGNATURE, RUN, FIRST = 44, 4, 4
#: Lines of fewer words than the second are banded by shingles, of as many as the first or more by pairs of words.
WORDS = (32, 44)
#: 4 * shared >= 3 * all shingles: a Jaccard similarity of 0.75.
SIMILARITY = (3, 4)
#: Lines of its bands' largest components that a line outside tries before all are compared.
TRIES = 4
#: Lines of a band that are compared with its others in the first round after those, about.
PIVOTS = 8
#: Words of 64 bits in the filters that keep needless rows out of exchanges; their size is fixed (2 MB).
_FILTER_WORDS = 1 << 18
_HAS_WORD = r"[^\x20\x09-\x0D]"
#: Once for every line with a word.
_LINE_START = r"(?:\A|\n)[\x20\x09\x0B-\x0D]*+[^\x20\x09-\x0D]"


def shingles(line: Column) -> Column:
    """Hashes of all windows of SHINGLE characters, with repeats; a shorter line is one window."""
    last = 4 * F.greatest(F.length(line) - SHINGLE, F.lit(0)) + 1
    # four bytes a character: a window is found without counting characters from the start
    return let(
        F.encode(line, "UTF-32"),
        lambda code: F.transform(F.sequence(F.lit(1), last, F.lit(4)), lambda at: F.xxhash64(code.substr(at, F.lit(4 * SHINGLE)))),
    )


def _pairs_of_words(words: Column) -> Column:
    return F.zip_with(words, F.slice(words, F.lit(2), F.size(words)), lambda a, b: F.xxhash64(a, b))


def _band_rows(lines: DataFrame) -> DataFrame:
    """(id, band) of rows (id, line); a band may come twice."""
    few, many = WORDS
    split = lines.select("id", "line", F.split("line", " ").alias("words"))
    n = F.size("words")
    by_shingles, by_words = shingles(F.col("line")), _pairs_of_words(F.col("words"))
    # of pairs of words there are fewer, and a letter changes two of them: more runs make up for it
    by_shingles, by_words = (F.struct(h.alias("hashes"), F.lit(m).alias("mask")) for h, m in ((by_shingles, 3), (by_words, 1)))
    forms = F.when(n < few, F.array(by_shingles)).when(n >= many, F.array(by_words)).otherwise(F.array(by_shingles, by_words))
    form = split.select("id", F.inline(forms))
    values = form.select("id", "mask", F.slice(F.sort_array(F.array_distinct("hashes")), 1, SIGNATURE).alias("v"))
    shifted = [F.slice("v", F.lit(i + 1), F.size("v")).alias(f"v{i}") for i in range(RUN)]
    places = values.select("id", "mask", F.size("v").alias("n"), F.posexplode(F.arrays_zip(*shifted)).alias("place", "run"))
    divisible = F.col("run.v0").bitwiseAND(F.when(F.col("n") < SIGNATURE, 1).otherwise(F.col("mask")).cast("bigint")) == 0
    starts = (F.col("place") == 0) | (((F.col("place") < FIRST) | divisible) & (F.col("place") <= F.col("n") - RUN))
    return places.where(starts).select("id", F.xxhash64("run").alias("band"))


def banded(lines: DataFrame) -> DataFrame:
    """(id, bands) of rows (id, line)."""
    return _band_rows(lines).groupBy("id").agg(F.collect_set("band").alias("bands"))


def _lines(docs: DataFrame) -> DataFrame:
    """(key, doc_id, line_no, line) of all lines with a word."""
    split = F.posexplode(F.split("text", "\n")).alias("line_no", "line")
    rows = docs.select(F.xxhash64("doc_id", "text").alias("key"), "doc_id", split)
    return rows.where(F.col("line").rlike(_HAS_WORD))


def _filter(values: DataFrame, column: str) -> DataFrame:
    """One row ``bits`` of fixed size that holds every value of the column (and others by chance)."""
    spark = values.sparkSession
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), _bit(F.col(column)))
    words = values.groupBy(_word(F.col(column)).alias("id")).agg(F.bit_or(bit).alias("w"))
    every = spark.range(_FILTER_WORDS).join(words, "id", "left")
    ordered = F.array_sort(F.collect_list(F.struct("id", F.coalesce("w", F.lit(0).cast("bigint")).alias("w"))))
    return every.agg(F.transform(ordered, lambda x: x["w"]).alias("bits"))


def _word(value: Column) -> Column:
    return F.pmod(value, F.lit(_FILTER_WORDS))


def _bit(value: Column) -> Column:
    return F.shiftrightunsigned(value, 40).bitwiseAND(F.lit(63)).cast("int")


def _maybe_in(rows: DataFrame, column: str, bits: DataFrame) -> DataFrame:
    word = F.get(F.col("_bits"), _word(F.col(column)).cast("int"))
    found = F.call_function("shiftright", word, _bit(F.col(column))).bitwiseAND(F.lit(1)) == 1
    return rows.withColumn("_bits", bits.scalar()).where(found).drop("_bits")


def _similar(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (hub, id) whose whole shingle sets are similar, given (id, line)."""
    both = pairs.join(texts.select(F.col("id").alias("hub"), F.col("line").alias("a")), "hub").join(texts.withColumnRenamed("line", "b"), "id")
    sets = both.select("hub", "id", *[F.array_distinct(shingles(F.col(c))).alias(c) for c in ("a", "b")])
    least, of = SIMILARITY
    similar = (least + of) * F.size(F.array_intersect("a", "b")) >= least * (F.size("a") + F.size("b"))
    return held(sets, similar).select("hub", "id")


def _apart(left: DataFrame, found: DataFrame, number: int) -> DataFrame:
    """Of the lines ``left`` (band, id) of each band, those of bands that hold several components.

    Adds ``component``, the band's ``largest`` component, ``other``, a line of that one, and ``rest``, the number of lines outside it.
    """
    named = left.join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    some = F.min(F.struct(F.xxhash64("id", F.lit(number)).alias("h"), "id"))["id"]
    sizes = named.groupBy("band", "component").agg(F.count(F.lit(1)).alias("n"), some.alias("other"))
    bands = sizes.groupBy("band").agg(
        F.max(F.struct("n", "component", "other")).alias("most"), (F.sum("n") - F.max("n")).alias("rest")
    )
    bands = bands.where("rest > 0").select("band", "rest", F.col("most.component").alias("largest"), F.col("most.other").alias("other"))
    return named.join(bands, "band")


def _tried(left: DataFrame) -> DataFrame:
    """(hub, id): of each line outside its bands' largest components up to TRIES pairs with lines of these."""
    outside = left.where("component != largest").groupBy("id").agg(F.collect_set("other").alias("others"))
    return _pairs(outside.select("id", F.explode(F.slice("others", 1, TRIES)).alias("other")))


def _pairs(rows: DataFrame) -> DataFrame:
    return rows.select(F.least("other", "id").alias("hub"), F.greatest("other", "id").alias("id")).distinct()


def _joined(found: DataFrame, links: DataFrame) -> DataFrame:
    """``found`` with the components of linked lines made one; components are joined instead of their lines."""
    of = lambda c: found.select(F.col("id").alias(c), F.col("component").alias(f"{c}_component"))
    ends = links.join(of("hub"), "hub", "left").join(of("id"), "id", "left")
    ends = ends.select(F.coalesce("hub_component", "hub").alias("a"), F.coalesce("id_component", "id").alias("b"))
    joined = connected(ends, "a", "b").select(F.col("node").alias("component"), F.col("component").alias("root"))
    moved = found.join(joined, "component", "left").select("id", F.coalesce("root", "component").alias("component"))
    new = joined.select(F.col("component").alias("id"), F.col("root").alias("component"))
    return written(moved.union(new).groupBy("id").agg(F.min("component").alias("component")), "found")


def _linked(left: DataFrame, texts: DataFrame, found: DataFrame, compared: DataFrame, pivots: int = PIVOTS) -> DataFrame:
    """(id, component) when all lines of a band that are not yet in one component were compared.

    ``left`` has (band, id), ``found`` the components by the pairs ``compared``. First each line outside its band's largest
    component tries a few lines of it, which brings most lines of a crowded band together. Then, in each round, about ``pivots``
    lines of a band outside its largest component are compared with all its lines of other components and leave the band; others
    get eight times as many pivots in the next, until none is left. No pair is compared twice.
    """
    number = 0
    while True:
        left = written(_apart(left.select("band", "id"), found, number), "apart")
        if left.isEmpty():
            return found
        if number == 0:
            pairs = _tried(left)
        else:
            # a pivot of one band is mostly one of its other bands too, so few different pairs come of many bands
            chosen = F.pmod(F.xxhash64("id", F.lit(number)), F.col("rest")) < pivots
            pivot = (F.col("component") != F.col("largest")) & chosen
            first = left.where(pivot).select("band", F.col("id").alias("_pivot"), F.col("component").alias("own"))
            pairs = _pairs(left.drop("other").join(first, "band").where("component != own").select("id", F.col("_pivot").alias("other")))
            left, pivots = left.where(~pivot), 8 * pivots
        pairs = written(pairs.join(compared, ["hub", "id"], "left_anti"), "pairs")
        found = _joined(found, _similar(pairs, texts))
        compared, number = compared.union(pairs), number + 1


def _near(lines: DataFrame) -> DataFrame:
    """(band, hub, id) of the bands of several lines (id, line); the hub, a band's smallest line, is left out."""
    rows = written(_band_rows(lines), "bands")
    shared = written(
        rows.groupBy("band").agg(F.min("id").alias("hub"), F.max("id").alias("last")).where("hub != last").select("band", "hub"), "shared"
    )
    near = _maybe_in(rows, "band", _filter(shared, "band")).join(shared, "band")
    return near.where("id != hub").select("band", "hub", "id").distinct()


def line_components(docs: DataFrame) -> DataFrame:
    """(id, component) of the lines that are similar to a different line; ids are hashes of the line."""
    lines = _lines(docs).select(F.xxhash64("line").alias("id"), "line")
    near = settled("near", lambda: _near(lines))
    named = near.select("id").union(near.select("hub")).distinct()
    texts = _maybe_in(lines, "id", _filter(named, "id")).join(named, "id", "left_semi").dropDuplicates(["id"])
    texts = written(texts, "lines")
    # a hub is its band's smallest line, so the smallest is the one most lines of a crowd have in common
    pairs = written(near.groupBy("id").agg(F.min("hub").alias("hub")).select("hub", "id"), "pairs")
    found = written(connected(_similar(pairs, texts), "hub", "id").withColumnRenamed("node", "id"), "found")
    banded = near.select("band", "id").union(near.select("band", "hub").distinct())
    return _linked(banded, texts, found, pairs)


def duplicate_lines(docs: DataFrame) -> DataFrame:
    """(key, doc_id, n_lines, dropped) per row of ``docs``.

    ``n_lines`` counts the \\n-separated lines with a word, ``dropped`` has the numbers (from 0) of those that go:
    equal or similar to a line of the same component with a smaller (document id, line number), null ids last.
    Lines without a word belong to no component and are never dropped. Null and empty texts have no lines. ``key`` hashes id and text; rows
    that agree in both are one document and get the same result. Other columns are ignored.
    """
    placed = _lines(docs).select("key", "doc_id", "line_no", F.xxhash64("line").alias("id"))
    grouped = settled("components", lambda: line_components(docs))
    placed = placed.join(grouped, "id", "left").withColumn("component", F.coalesce("component", "id"))
    order = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "key", "line_no")
    # components with a single place have nothing to drop
    first = placed.groupBy("component").agg(F.min(order).alias("first"), F.max(order).alias("last")).where("first != last")
    later = placed.join(first, "component").where(order != F.col("first"))
    dropped = later.groupBy("key").agg(F.sort_array(F.collect_set("line_no")).alias("dropped"))
    n_lines = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(_LINE_START)).cast("bigint")
    rows = docs.select(F.xxhash64("doc_id", "text").alias("key"), "doc_id", n_lines.alias("n_lines"))
    return rows.join(dropped, "key", "left").select(
        "key", "doc_id", "n_lines", F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped")
    )


def keep_first_lines(docs: DataFrame) -> DataFrame:
    """``docs`` without duplicate lines; documents that lose all their words go.

    Texts that lose no line stay as they are, others are the remaining lines, and ``n_chars`` follows if there is such a column.
    """
    found = duplicate_lines(docs).where(F.size("dropped") > 0).select(F.col("key").alias("_key"), "dropped").distinct()
    rows = docs.select(F.struct("*").alias("row"), F.xxhash64("doc_id", "text").alias("_key"))
    lines = F.split(F.col("row.text"), "\n")
    left = let(
        lines,
        lambda x: F.array_join(
            F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("dropped")), lambda i: F.get(x, i)), "\n"
        ),
    )
    joined = rows.join(found, "_key", "left").withColumn("_text", F.when(F.col("dropped").isNotNull(), left))
    joined = held(joined, F.col("_text").isNull() | F.col("_text").rlike(_HAS_WORD))
    columns = []
    for f in docs.schema.fields:
        value = F.col("row").getField(f.name)
        if f.name == "text":
            value = F.coalesce("_text", value)
        elif f.name == "n_chars":
            value = F.coalesce(F.length("_text").cast(f.dataType), value)
        columns.append(value.alias(f.name))
    return joined.select(*columns)
