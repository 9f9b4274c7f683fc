"""Line deduplication by a deletion-neighbourhood join, in DataFrame operations only.

Equal lines are found by a 128-bit hash.  Lines one edit apart agree in all but one short piece, so lines are first
thinned out by their halves and then by their pieces (hashes of all but the piece); within a piece that two lines leave
open, each line emits itself with each character deleted.  A pair that differs by one substitution meets at the variant
without that character, a pair that differs by one insertion where the longer line's variant is the shorter line.
Groups are settled by their minima, so that no pairs are listed; the edit distance to the partner is verified at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Stage, scratch

#: Unless dedup is told otherwise, shorter lines are compared exactly; the SQL has the same floor.
MIN_FUZZY = 20
PIECE = 32
LAST = (1 << 63) - 1
#: What a line that isn't blank has.
SOLID = r"[^ \t\r\x0b\x0c]"


def _row() -> tuple[Column, Column]:
    """What tells rows apart: doc_id, the greatest long where it is null, and the text's hash.  Equal rows share both."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)), F.xxhash64(F.col("text").cast("string"))


def lines(docs: DataFrame) -> DataFrame:
    """(d, t, no, line): the non-blank lines of each row, which d and t stand for."""
    d, t = _row()
    return docs.select(d.alias("d"), t.alias("t"), F.posexplode(F.split(F.col("text").cast("string"), "\n", -1)).alias("no", "line")).where(F.col("line").rlike(SOLID))


def _halves() -> Column:
    """Hashes of the line's first and second half, as a line of its length and as one from which a character is missing."""
    same, longer = F.col("n"), F.col("n") + 1
    return F.array(*[
        F.xxhash64(m, F.lit(side), F.expr(f"substring(line, {a}, {b})"))
        for m, half, back in ((same, "int(n / 2)", "0"), (longer, "int((n + 1) / 2)", "1"))
        for side, a, b in ((0, "1", half), (1, f"{half} - {back} + 1", "n"))
    ])


def _shared_keys(keyed: DataFrame) -> DataFrame:
    """``keyed`` (key, ...id h, g) without the keys that only one line has."""
    many = keyed.groupBy("key").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a <> b").select("key")
    return keyed.join(many, "key", "left_semi")


def near_removed(distinct: DataFrame, docs: DataFrame, min_fuzzy: int = MIN_FUZZY) -> DataFrame:
    """(h, g) of the distinct lines (h, g, n, d, t, no, keys) that stand one edit from a line whose first place is earlier."""
    fuzzy = distinct.where(F.col("n") >= min_fuzzy)
    halves = _shared_keys(fuzzy.select("h", "g", F.explode("keys").alias("key")))
    kept = halves.select("h", "g").distinct().join(fuzzy, ["h", "g"]).select("h", "g", "n", "d", "t", "no")
    wanted = kept.groupBy("d", "t").agg(F.sort_array(F.collect_set("no")).alias("nos"))
    d, t = _row()
    some = docs.select(d.alias("d"), t.alias("t"), "text").join(wanted.hint("merge"), ["d", "t"])  # the lists grow with the input: never broadcast
    found = some.select("d", "t", F.split(F.col("text").cast("string"), "\n", -1).alias("all"), "nos").select(F.explode(F.transform("nos", lambda i: F.struct(i.alias("no"), F.get("all", i).alias("line")))).alias("x")).select("x.*")
    found = found.where("line is not null").select(F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("g"), "line").join(kept, ["h", "g"]).dropDuplicates(["h", "g"])
    texts = Stage(found.select("h", "g", "n", "d", "t", "no", "line"), "lines")

    # all but one piece, for the line's own length and, as the shorter of a pair, for the next
    def pieces(m: str, short: int) -> str:
        # piece j of a line of m characters is its characters j * PIECE + 1 .. (j + 1) * PIECE; a shorter line has one less
        return f"""transform(sequence(0, int(({m} - 1) / {PIECE})), j -> struct({m} as m, j as j, {short} as short,
            xxhash64({m}, j, substring(line, 1, j * {PIECE}), substring(line, (j + 1) * {PIECE} + 1 - {short}, n)) as key))"""

    keyed = texts.df.select("h", "g", "n", F.explode(F.expr(f"concat({pieces('n', 0)}, {pieces('(n + 1)', 1)})")).alias("p")).select("h", "g", "p.*")
    open_pieces = _shared_keys(keyed.where("key is not null"))
    at = open_pieces.join(texts.df, ["h", "g"]).withColumn("piece", F.expr(f"substring(line, j * {PIECE} + 1, {PIECE} - short)"))
    whole = "array(struct(xxhash64(key, 0, piece) as v, true as short))"
    cut = "concat(substring(piece, 1, i - 1), substring(piece, i + 1))"
    variants = f"""flatten(transform(sequence(1, length(piece)), i -> array(
        struct(xxhash64(key, 0, {cut}) as v, false as short), struct(xxhash64(key, i, {cut}) as v, false as short))))"""
    emitted = at.select("h", "g", "d", "t", "no", F.explode(F.expr(f"case when short = 1 then {whole} when piece <> '' then {variants} end")).alias("e"))
    emitted = emitted.select("e.v", "e.short", F.struct("d", "t", "no", "h", "g").alias("me"))
    groups = emitted.groupBy("v").agg(
        F.min("me").alias("low"), F.max("me").alias("high"), F.min(F.when(F.col("short"), F.col("me"))).alias("low_short"), F.min(F.when(~F.col("short"), F.col("me"))).alias("low_long"), F.max(F.when(~F.col("short"), F.col("me"))).alias("high_long")
    ).where("low <> high")
    # substitution and equal-variant groups: the earliest longer line against the others; the shorter line against the earliest longer one
    member = emitted.join(groups, "v")
    pairs = member.select("me", F.explode(F.array_compact(F.array(
        F.when(~F.col("short") & (F.col("low_long") < F.col("me")), F.col("low_long")),
        F.when(~F.col("short") & (F.col("low_short") < F.col("me")), F.col("low_short")),
        F.when(F.col("short") & (F.col("low_long") < F.col("me")), F.col("low_long")),
    ))).alias("other")).distinct()
    mine = texts.df.select("h", "g", F.col("line").alias("a"))
    theirs = texts.df.select(F.col("h").alias("oh"), F.col("g").alias("og"), F.col("line").alias("b"))
    checked = pairs.select("me.h", "me.g", F.col("other.h").alias("oh"), F.col("other.g").alias("og")).join(mine, ["h", "g"]).join(theirs, ["oh", "og"])
    return checked.where(F.levenshtein("a", "b", 1) >= 0).select("h", "g").distinct()


def _gone(docs: DataFrame, min_fuzzy: int) -> DataFrame:
    """(d, t, gone__nos): the numbers of the lines that each row loses, of equal rows the first."""
    all_lines = lines(docs).select("d", "t", "no", F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("g"), F.length("line").alias("n"), "line")
    keyed = all_lines.select("h", "g", "n", F.struct("d", "t", "no").alias("at"), _halves().alias("keys"))
    distinct = keyed.groupBy("h", "g").agg(F.min("at").alias("at"), F.count("*").alias("places"), F.min("n").alias("n"), F.min("keys").alias("keys"))
    distinct = Stage(distinct.select("h", "g", "n", "at.d", "at.t", "at.no", (F.col("places") > 1).alias("many"), "keys"), "distinct-lines").df
    near = Stage(near_removed(distinct, docs, min_fuzzy), "near-lines").df.withColumn("near", F.lit(True))
    goes = distinct.join(near, ["h", "g"], "left").where("many or near").select("h", "g", F.when(F.col("near").isNull(), F.struct("d", "t", "no")).alias("keep"))
    gone = all_lines.select("h", "g", F.struct("d", "t", "no").alias("at")).join(goes, ["h", "g"]).where(F.col("keep").isNull() | (F.col("at") != F.col("keep")))
    return gone.select("at.*").groupBy("d", "t").agg(F.collect_set("no").alias("gone__nos"))


def dedup(docs: DataFrame, min_fuzzy: int = MIN_FUZZY) -> DataFrame:
    """Each row of ``docs`` with its lines that an earlier line makes redundant taken out.

    A non-blank line goes if an equal line, or (for lines of ``min_fuzzy`` characters or more) one a single edit away, stands earlier:
    in a document with a smaller doc_id, or higher up in the same.  Blank lines stay.  Returns all columns of ``docs`` with
    text replaced and n_lines, n_removed (long) added or replaced.  Null texts stay null, with no lines.  Every row is a
    document of its own: rows without a doc_id stand after all others, and rows of one doc_id or of none stand by the hash
    of their texts; of rows equal in both, one stands first and the others lose all their lines.  An empty table gives no
    rows.
    """
    with scratch():
        gone = Stage(_gone(docs, min_fuzzy), "gone-lines").keep().df
    d, t = _row()
    place = F.row_number().over(Window.partitionBy("d__key", "t__key").orderBy("d__key"))  # the join's own exchange and order
    rows = docs.withColumns({"d__key": d, "t__key": t}).withColumn("place__key", place)
    rows = rows.join(gone.withColumnsRenamed({"d": "d__key", "t": "t__key"}).hint("merge"), ["d__key", "t__key"], "left")
    parts = F.split(F.col("text").cast("string"), "\n", -1)
    count = F.coalesce(F.size(F.filter(parts, lambda x: x.rlike(SOLID))), F.lit(0)).cast("long")
    blank = F.filter(parts, lambda x: ~x.rlike(SOLID))
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("gone__nos")), lambda i: F.get(parts, i))
    whole = F.col("text").cast("string")
    text = F.when(F.col("text").isNull(), whole).when(F.col("place__key") > 1, F.array_join(blank, "\n")).when(F.col("gone__nos").isNull(), whole).otherwise(F.array_join(left, "\n"))
    removed = F.when(F.col("text").isNull(), 0).when(F.col("place__key") > 1, count).when(F.col("gone__nos").isNull(), 0).otherwise(F.size("gone__nos"))
    kept = [c for c in docs.columns if c not in ("text", "n_lines", "n_removed")]
    return rows.select(*kept, text.alias("text"), count.alias("n_lines"), removed.cast("long").alias("n_removed"))
