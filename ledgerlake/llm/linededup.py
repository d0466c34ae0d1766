"""Line dedup by winnowing over line hashes, with DataFrame functions only.

The lines of a text that aren't blank are hashed (trimmed of ASCII white space). Every `gram` consecutive lines form a
gram; in each window of `window` grams the rightmost smallest hash is selected. So any run of gram + window - 1 equal
lines in two places selects the same grams in both (the guarantee of winnowing). Positions that share a selected gram
with another position are joined. A match is extended from there both ways, by window - 1 lines at most: beyond that the
next fingerprint of the match takes over, as no two are further apart. The extensions are known by the hash of their
lines (a run of gram + window - 1 lines around the fingerprint); of those that stand in several places all but the first -
smallest doc_id, then earliest in the text - are deleted. Runs that overlap or touch are one deletion; blank lines inside
it go too.

What is joined: fingerprints that repeat with their positions (AQE splits one that is in a third of all texts, since both
sides are tables), and first places with all places, by run and place, which spreads any run. No pairs are made.

Shorter repeats count on request (short_words): a line of that many words or more, and a whole text of fewer lines than a
run, are units of their own in the same search for the first position. The registered query and the pipeline's stage
leave it off, as their SQL and tests have runs only.

Defined cases: a null or empty text has one blank line and loses nothing; texts with fewer lines than a run keep them
all, unless short repeats count; rows that share a doc_id are told apart by their text, and rows equal in both count as one document; a null doc_id
sorts before all others; all other columns are carried along untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import Scratch, columns

GRAM, WINDOW = 2, 2
#: What counts as white space around a line (fixed values).
BLANKS = " \t\r\x0b\x0c"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _solid(lines: Column) -> Column:
    """Line number and hash of the lines that aren't blank."""
    every = F.transform(lines, lambda x, i: F.struct(i.alias("at"), F.trim(x, F.lit(BLANKS)).alias("s")))
    return F.transform(F.filter(every, lambda x: x.s != ""), lambda x: F.struct(x["at"].alias("at"), F.xxhash64(x.s).alias("h")))


def fingerprints(docs: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """key, pos, fingerprint and the line hashes around it, for each selected gram. docs: key struct, h array of hashes."""
    grams = docs.withColumn("g", F.when(F.size("h") >= gram + window - 1, F.transform(F.sequence(F.lit(0), F.size("h") - gram), lambda i: F.struct(F.xxhash64(*(F.get("h", i + j) for j in range(gram))).alias("v"), (-i).alias("p")))))
    picked = grams.withColumn("p", F.when(F.col("g").isNotNull(), F.array_distinct(F.transform(F.sequence(F.lit(0), F.size("g") - window), lambda i: F.array_min(F.slice("g", i + 1, window))))))
    # explode_outer: for explode, Catalyst infers a filter on the array's size, pushes it to the scan and there spells
    # the arrays out within each lambda, which makes their cost quadratic and worse.
    rows = picked.select("key", "h", F.explode_outer("p").alias("p")).where("p is not null").select("key", "h", (-F.col("p.p")).alias("pos"), F.col("p.v").alias("fingerprint"))
    start = F.greatest(F.col("pos") - (window - 1), F.lit(0))
    return rows.select("key", "pos", "fingerprint", start.alias("start"), F.slice("h", start + 1, F.col("pos") + gram + window - 1 - start).alias("around"))


def short_units(docs: DataFrame, size: int, short_words: int) -> DataFrame:
    """key, start, stop, run1, run2 (hashes) of each line of short_words words or more and of each whole text of fewer lines than size."""
    solid = F.filter(F.transform(_lines(F.col("text")), lambda x: F.trim(x, F.lit(BLANKS))), lambda x: x != "")

    def unit(start: Column, stop: Column, kind: str, s: Column) -> Column:
        return F.struct(start.cast("int").alias("start"), stop.cast("int").alias("stop"), *(F.xxhash64(F.lit(seed), F.lit(kind), s).alias(f"run{seed}") for seed in (1, 2)))

    long_line = lambda x: F.size(F.split(x, f"[{BLANKS}]+")) >= short_words
    lines = F.filter(F.transform("solid", lambda x, i: F.struct(long_line(x).alias("long"), unit(i, i + 1, "line", x).alias("u"))), lambda x: x["long"])
    whole = F.when((F.size("solid") > 0) & (F.size("solid") < size), F.array(unit(F.lit(0), F.size("solid"), "text", F.array_join("solid", "\n")))).otherwise(F.array())
    rows = docs.select(_key(), solid.alias("solid")).select("key", F.concat(F.transform(lines, lambda x: x["u"]), whole).alias("units"))
    return rows.select("key", F.explode_outer("units").alias("u")).where("u is not null").select("key", "u.*")


def _key() -> Column:
    return F.struct(F.col("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash")).alias("key")


def repeated_runs(docs: DataFrame, scratch: Scratch, gram: int = GRAM, window: int = WINDOW, short_words: int | None = None) -> DataFrame:
    """key, start, stop (in lines that aren't blank) of each run to delete. docs: doc_id, text."""
    size = gram + window - 1
    base = docs.select(_key(), F.transform(_solid(_lines(F.col("text"))), lambda x: x.h).alias("h"))
    marks = fingerprints(base, gram, window)
    place = F.struct("key", "pos")
    # Written, so that the join below has a table on each side and AQE can split the rows of a very common fingerprint.
    again = scratch.save(marks.groupBy("fingerprint").agg(F.min(place).alias("low"), F.max(place).alias("high")).where("low <> high").select("fingerprint"), "again")
    near = marks.join(again, "fingerprint")
    shift = F.transform(F.sequence(F.lit(0), F.size("around") - size), lambda i: F.struct((F.col("start") + i).alias("start"), F.struct(*(F.xxhash64(F.lit(seed), *(F.get("around", i + j) for j in range(size))) for seed in (1, 2))).alias("run")))
    runs = near.where(F.size("around") >= size).select("key", F.explode_outer(shift).alias("r")).select("key", "r.start", (F.col("r.start") + size).alias("stop"), F.col("r.run.col1").alias("run1"), F.col("r.run.col2").alias("run2"))
    if short_words is not None:
        runs = runs.unionByName(short_units(docs, size, short_words))
    runs = scratch.save(runs.select(F.col("key.doc_id").alias("doc_id"), F.col("key.text_hash").alias("text_hash"), "start", "stop", "run1", "run2"), "runs")
    # All places of a run but the first go. The first ones are taken out by run and place, so that the rows of a run in a
    # third of all texts are spread by their place.
    at = F.struct("doc_id", "text_hash", "start")
    first = runs.groupBy("run1", "run2").agg(F.min(at).alias("low")).select("run1", "run2", "low.*")
    r, f = runs.alias("r"), first.alias("f")
    same = F.col("r.doc_id").eqNullSafe(F.col("f.doc_id"))
    for c in ("text_hash", "start", "run1", "run2"):
        same &= F.col(f"r.{c}") == F.col(f"f.{c}")
    later = r.join(f, same, "left_anti").select("doc_id", "text_hash", "start", "stop").distinct()
    from pyspark.sql import Window

    by_text = Window.partitionBy("doc_id", "text_hash").orderBy("start", "stop")
    reached = F.max("stop").over(by_text.rowsBetween(Window.unboundedPreceding, -1))
    fresh = later.withColumn("new", F.coalesce(F.col("start") > reached, F.lit(True)).cast("int"))
    numbered = fresh.withColumn("n", F.sum("new").over(by_text))
    return numbered.groupBy("doc_id", "text_hash", "n").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("n")


def _deduped(docs: DataFrame, gram: int, window: int, short_words: int | None) -> DataFrame:
    """row (the input's columns), text as kept, n_lines, n_removed, spans."""
    scratch = Scratch(docs.sparkSession, "linededup")
    slim = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    runs = repeated_runs(slim, scratch, gram, window, short_words).groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("runs"))
    own = docs.select(F.struct(*columns(docs)).alias("row"), F.col("doc_id").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("hash", F.xxhash64("text"))
    joined = own.join(runs, (F.col("hash") == F.col("text_hash")) & F.col("id").eqNullSafe(F.col("doc_id")), "left")
    told = (
        joined.withColumn("lines", _lines(F.col("text")))
        .withColumn("at", F.when(F.col("runs").isNotNull(), F.transform(_solid(F.col("lines")), lambda x: x["at"])))
        .withColumn("n_lines", F.size("lines"))
        .withColumn("n_removed", F.coalesce(F.aggregate("runs", F.lit(0), lambda n, r: n + r.stop - r.start), F.lit(0)))
        .withColumn("spans", F.coalesce(F.transform("runs", lambda r: F.struct(F.get("at", r.start).alias("start"), (F.get("at", r.stop - 1) + 1).alias("stop"))), F.expr("cast(array() as array<struct<start:int,stop:int>>)")))
    )
    spans = F.col("spans")
    gaps = F.transform(F.sequence(F.lit(0), F.size(spans)), lambda i: F.struct(F.coalesce(F.get(spans, i - 1)["stop"], F.lit(0)).alias("a"), F.coalesce(F.get(spans, i)["start"], F.col("n_lines")).alias("b")))
    kept = F.array_join(F.flatten(F.transform(gaps, lambda g: F.slice("lines", g.a + 1, g.b - g.a))), "\n")
    return told.select("row", F.when(F.size(spans) > 0, kept).otherwise(F.col("text")).alias("text"), "n_lines", "n_removed", "spans")


def dedup_lines(docs: DataFrame, gram: int = GRAM, window: int = WINDOW, short_words: int | None = None) -> DataFrame:
    """The documents with `text` as kept, and n_lines, n_removed (lines that weren't blank), and spans: the runs deleted, in
    lines of the input. If the input has a column of such a name, it stays and the new one's name gets an underscore."""
    told = _deduped(docs, gram, window, short_words)
    out, taken = [F.col("text").alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns], set(docs.columns)
    for name in ("n_lines", "n_removed", "spans"):
        free = name
        while free in taken:
            free += "_"
        taken.add(free)
        out.append(F.col(name).alias(free))
    return told.select(*out)


def dedup_documents(docs: DataFrame, short_words: int | None = None) -> DataFrame:
    """The documents with repeated runs gone, and n_chars as it is now; other columns as they were. A text that lost all its lines goes with them: all of it stands elsewhere."""
    out = _deduped(docs, GRAM, WINDOW, short_words).where(~((F.col("n_removed") > 0) & (F.trim(F.col("text"), F.lit(BLANKS + "\n")) == "")))
    made = {c: F.col("row")[c] for c in docs.columns} | {"text": F.when(F.col("n_removed") > 0, F.col("text")).otherwise(F.col("row")["text"])}
    if "n_chars" in made:
        made["n_chars"] = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(made["n_chars"])
    return out.select(*(made[c].alias(c) for c in docs.columns))
