"""Line deduplication by a deletion-neighbourhood join. DataFrame functions only.

Two lines are near if they are within one edit (a character put in, left out or changed), however short they are. A candidate
gives the hashes of its variants with one character left out, each with its place, and its own hash as the variant of longer
lines: lines that share a key are within one edit, which Levenshtein's distance then confirms. A key's group holds at most one
line for each character that can stand at its place, so groups are bounded. Of near lines the earliest stays, by doc_id and line.

Variants are made only where they can meet another's. A line is a candidate if another shares its first or its last half: one
edit leaves either whole (each line is cut as the longer and as the shorter of two). And a character is left out only in
stretches of STRETCH characters beside which another line is the same. Where nothing is left to compare (halves of lines of up
to three characters, both sides of a stretch as long as the line) there is no key, and all such lines are candidates.

Lines are the same if 128 bits of their hashes are. The places of lines that are very frequent are not shuffled by line: at most
HOT_LINES lines have a share 1 / HOT_LINES of all places or more, so those lines' first places are broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import store

STRETCH = 16
#: Lines of more than a 1 / HOT_LINES share of all places, of which there can't be more than so many, are joined by broadcast.
HOT_LINES = 100_000
#: Bits of the filter that keeps other lines' texts out of the shuffle: at most 8 MB, whatever the number of candidates.
FILTER_BITS = 1 << 26


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, th, pos, line, lid, lid2): each line with a word; th tells apart rows of one doc_id."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    whole = docs.select("doc_id", F.xxhash64(text).alias("th"), text.alias("text"))  # a step of its own, or each line's row hashes the whole text
    rows = whole.select("doc_id", "th", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    rows = rows.filter(F.col("line").rlike(r"[^\x20\x09-\x0D]"))
    return rows.withColumn("lid", F.xxhash64("line")).withColumn("lid2", F.xxhash64(F.lit(11), "line", F.length("line")))


def _part_keys() -> Column:
    """Hashes of a line's ends, of the sizes that it shares with lines as long or one character shorter or longer."""
    keys = []
    for less in (1, 2):
        size = f"cast((n - {less}) div 2 as int)"
        keys += [F.expr(f"CASE WHEN {size} > 0 THEN xxhash64('{end}', {size}, {side}(line, {size})) END") for end, side in (("first", "left"), ("last", "right"))]
    return F.array_distinct(F.array_compact(F.array(*keys)))


def _stretch_keys() -> Column:
    """(i, key) of each stretch: all before place i and all behind the stretch, hashed; behind it as the longer and as the shorter of two lines."""
    behind = lambda less: f"greatest(0, n - i - {less})"
    key = lambda less: f"struct(i, xxhash64(i, {behind(less)}, left(line, i), right(line, {behind(less)})) AS key)"
    keys = lambda less: f"transform(filter(sequence(0, n, {STRETCH}), i -> i + {behind(less)} > 0), i -> {key(less)})"
    return F.expr(f"concat({keys(STRETCH)}, {keys(STRETCH - 1)})")


def _variant_keys() -> Column:
    """Keys of a line with a character left out in the stretch at i: (length, place, rest) with the lowest bit 0 for a changed character, the bare rest with 1 for one left out; and its own hash with 1."""
    rest = "concat(left(line, p - 1), substring(line, p + 1))"
    return F.expr(f"""flatten(array(array(xxhash64(line) | 1L), flatten(transform(filter(sequence(i + 1, i + {STRETCH}), p -> p <= n), p ->
        array(xxhash64(n, p, {rest}) & -2L, xxhash64({rest}) | 1L)))))""")


def _mostly(lines: DataFrame, some: DataFrame) -> DataFrame:
    """``lines`` whose lid may be among ``some``'s: a bitmap of hashed lids, sent to all tasks; a few others come through as well."""
    place = F.pmod("lid", F.lit(FILTER_BITS)) + 1
    bits = some.select(F.bitmap_bucket_number(place).alias("bucket"), F.bitmap_bit_position(place).alias("bit")).groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))
    rows = lines.withColumn("bucket", F.bitmap_bucket_number(place)).withColumn("bit", F.bitmap_bit_position(place)).join(F.broadcast(bits), "bucket")
    on = F.expr("shiftright(cast(conv(hex(substring(bits, cast(bit div 8 as int) + 1, 1)), 16, 10) as int), cast(bit % 8 as int)) & 1 = 1")
    return rows.filter(on).select(*lines.columns)


def _first_places(places: DataFrame) -> DataFrame:
    """(lid, lid2, first, n): each distinct line's first place and the number of its places."""
    return store.written(places.groupBy("lid", "lid2").agg(F.min(F.struct("doc_id", "th", "pos")).alias("first"), F.count("*").alias("n")), "line-first")


def near_lines(docs: DataFrame, firsts: DataFrame, min_chars: int = 1) -> DataFrame:
    """(lid, lid2, first, earlier): each distinct line that is near an earlier one, with the places (doc_id, th, pos) of both; ``firsts``: of the lines of ``docs``."""
    first = firsts.groupBy("lid").agg(F.min(F.struct("first", "lid2")).alias("f")).select("lid", "f.first", "f.lid2")  # of two lines with one lid, which is all but impossible, the other isn't compared
    all_lines = _lines(docs).select("lid", "line", F.length("line").alias("n")).filter(F.col("n") >= min_chars)
    keys_at = store.new_path(docs.sparkSession, "line-keys")
    keys = store.written(all_lines.select("lid", F.explode(_part_keys()).alias("key")).distinct(), "line-keys", keys_at)
    shared = keys.groupBy("key").agg(F.min("lid").alias("a"), F.max("lid").alias("b")).filter("a < b").select("key")
    tiny = all_lines.filter("n <= 3").select("lid")
    some = store.written(keys.join(shared, "key").select("lid").union(tiny).distinct(), "line-candidates")
    store.delete(docs.sparkSession, keys_at)
    # An inner join (lids in ``some`` are distinct): a semi-join would be pushed below the filter.
    texts = store.written(_mostly(all_lines, some).distinct().join(some, "lid").dropDuplicates(["lid"]), "line-texts")
    stretches = store.written(texts.select("lid", F.inline(_stretch_keys())).distinct(), "line-stretches")
    twice = stretches.groupBy("key").agg(F.min("lid").alias("a"), F.max("lid").alias("b")).filter("a < b").select("key")
    places = stretches.join(twice, "key").select("lid", "i").union(texts.filter(F.col("n") <= STRETCH).select("lid", F.lit(0).alias("i"))).distinct()
    variants = texts.join(places, "lid").select("lid", F.explode(_variant_keys()).alias("key")).distinct().withColumn("many", F.count("*").over(Window.partitionBy("key"))).filter("many > 1").select("key", "lid")
    met = store.written(variants, "line-variants").join(texts.select("lid", "n"), "lid").join(first.select("lid", "first"), "lid")
    by_key = met.groupBy("key").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.min("first").alias("any"), F.min_by("first", F.struct("n", "first")).alias("short"))
    met = met.join(by_key, "key")
    changed = F.col("key").bitwiseAND(F.lit(1)) == 0
    of_long = F.when(F.col("n") > F.col("least"), F.col("short"))
    of_short = F.when((F.col("n") == F.col("least")) & (F.col("least") < F.col("most")), F.col("any"))
    met = met.select("lid", "first", F.when(changed, F.col("any")).otherwise(F.coalesce(of_long, of_short)).alias("earlier")).filter("earlier < first")
    best = met.groupBy("lid", "first").agg(F.min("earlier").alias("earlier"))
    other = first.join(texts, "lid").select(F.col("first").alias("earlier"), F.col("line").alias("earlier_line"))
    checked = best.join(texts.select("lid", "line"), "lid").join(other, "earlier").filter(F.levenshtein("line", "earlier_line", 1) >= 0)
    return store.written(checked.join(first.select("lid", "lid2"), "lid").select("lid", "lid2", "first", "earlier"), "line-near")


def dropped_lines(docs: DataFrame, min_chars: int = 1) -> DataFrame:
    """(doc_id, th, pos): each line of ``docs`` that repeats or nearly repeats an earlier one."""
    places = store.written(_lines(docs).select("doc_id", "th", "pos", "lid", "lid2"), "line-places")
    firsts = _first_places(places)
    near = near_lines(docs, firsts, min_chars).select("lid", "lid2", F.lit(True).alias("near"))
    marks = firsts.join(near, ["lid", "lid2"], "left").filter("n > 1 or near").select("lid", "lid2", "first", "n", F.coalesce("near", F.lit(False)).alias("near"))
    marks = store.written(marks, "line-marks")
    most = (firsts.agg(F.sum("n")).first()[0] or 0) / HOT_LINES
    hot, others = marks.filter(F.col("n") > most).drop("n"), marks.filter(F.col("n") <= most).drop("n")
    on = ["lid", "lid2"]
    rows = places.join(F.broadcast(hot), on)  # at most HOT_LINES rows
    rest = _mostly(places.join(F.broadcast(hot.select(*on)), on, "left_anti"), others).join(others, on)
    repeated = lambda x: x.filter(F.col("near") | ~F.struct("doc_id", "th", "pos").eqNullSafe(F.col("first"))).select("doc_id", "th", "pos")
    return repeated(rows).union(repeated(rest))


def deduplicated(docs: DataFrame, min_chars: int = 1) -> DataFrame:
    """``docs`` plus n_lines (lines with a word), n_dropped and kept_text: its lines without those that repeat an earlier one.

    Lines are split at \\n; those without a word are never dropped. A null or empty text has none and an empty kept_text. Rows
    alike in doc_id and text are one document. An earlier line counts whether or not it is dropped itself. Of lines of fewer than
    ``min_chars`` characters only the same ones are dropped. Time is linear in the lines of a text.
    """
    gone = dropped_lines(docs, min_chars).distinct().groupBy(F.col("doc_id").alias("d_"), F.col("th").alias("t_")).agg(F.collect_list("pos").alias("gone"))
    gone = store.written(gone, "line-gone")
    own = [c for c in docs.columns if c not in ("n_lines", "n_dropped", "kept_text")]
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    rows = docs.select(F.struct(*[docs[c] for c in own]).alias("row"), docs["doc_id"].alias("id"), text.alias("text"), F.xxhash64(text).alias("th"))
    rows = rows.join(gone, F.col("id").eqNullSafe(F.col("d_")) & (F.col("th") == F.col("t_")), "left")
    parts = F.split("text", "\n", -1)
    # A one-element transform binds the split text, which a lambda would split anew for each line.
    left = lambda lines: F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
    joined = F.transform(F.array(parts), lambda lines: F.array_join(F.transform(left(lines), lambda i: lines[i]), "\n"))[0]
    kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(joined)
    count = F.size(F.filter(parts, lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    dropped = F.coalesce(F.size("gone"), F.lit(0))
    return rows.select("row.*", count.cast("long").alias("n_lines"), dropped.cast("long").alias("n_dropped"), kept.alias("kept_text"))
