"""Line dedup by winnowing over line hashes, with DataFrame functions only.

A run is the shortest sequence of a document's lines from some line on that has MIN_LINES lines or MIN_WORDS words (blanks
inside a line, plus one); blank lines are passed over. A line goes if it lies in a run that also starts earlier: in a
document with a smaller id, or earlier in the same document. So of a passage that repeats the first occurrence stays, and a
common line alone stays everywhere unless it has MIN_WORDS words.

1. Winnowing: of each run the line with the least hash is its fingerprint (the leftmost of equal ones), so that equal
   runs share fingerprints at the same place, and neighbouring runs mostly share one. Only the places of fingerprints
   are kept, about every second line.
2. Places are joined by fingerprint: only those whose fingerprint stands in two places at least go on.
3. From such a place matches are extended both ways, to each run that it is the fingerprint of: as far as the run goes
   before it and behind it, other places match if the lines there are equal (by two hashes of 64 bits). Each distinct
   extent finds its first place by a partially aggregated minimum, and later places are joined back. Matching runs that
   overlap make up the maximal repeated run.
4. The lines of later repeated runs are deleted.

No step makes pairs of places, so a run that a third of all documents have costs one row per place. Places are counted by
partial aggregates, and runs or fingerprints with more than a partition's share of them (never more than there are
partitions) are broadcast to their places instead of gathering these in one task.

Defined results: a null text is empty and has one blank line; rows that repeat an id follow each other as parts of one
document, ordered by text, runs not crossing them; a null id sorts first; extra columns, of any name, are kept
(without_later_runs) or not read; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import fair_join, id_of, keyed, materialize

MIN_LINES, MIN_WORDS = 3, 50


def _words(line):
    trimmed = F.trim(line)
    return F.length(trimmed) - F.length(F.replace(trimmed, F.lit(" "), F.lit(""))) + 1


def _split(text):
    return F.split(text.cast("string"), "\n", -1)


def fingerprints(rows: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """Of rows (_key, _ord, _text), one row per place of a fingerprint: _key, _ord, fp_at (its number among the lines not
    blank), fp (its hash) and runs, those that it is the fingerprint of, from the first to the last: at (number of the
    run's first line among those not blank), lines (the run's line numbers), a and b (hashes of the run)."""
    lines = F.transform(_split(F.col("_text")), lambda x, i: F.struct(i.alias("i"), F.xxhash64(x).alias("h"), F.xxhash64(F.lit(1), x).alias("g"), F.trim(x) == "", _words(x).alias("w")))
    full = F.filter(lines, lambda x: ~x["col4"])
    arrays = rows.select("_key", "_ord", full.alias("_lines"))
    n = F.size("_lines")

    def run(k):
        """The run from line k on (null if the document ends first)."""
        total, size = F.lit(0), F.lit(None).cast("int")
        for m in range(1, min_lines + 1):
            total = total + F.coalesce(F.get("_lines", k + (m - 1))["w"], F.lit(0))
            enough = (total >= min_words) | F.lit(m == min_lines)
            size = F.coalesce(size, F.when(enough & (k + m <= F.size("_lines")), F.lit(m)))
        return F.struct(k.alias("at"), F.slice("_lines", k + 1, size).alias("part"))

    field = lambda part, f: F.transform(part, lambda x: x[f])

    def marked(r):
        h = field(r["part"], "h")
        return F.struct(r["at"].alias("at"), r["part"].alias("part"), (r["at"] + F.array_position(h, F.array_min(h)).cast("int") - 1).alias("fp_at"))

    # a run never ends before that of the line ahead: the runs found are those of the first lines, and fp_at never falls
    found = F.filter(F.transform(F.sequence(F.lit(0), n - 1), run), lambda r: r["part"].isNotNull())
    windows = arrays.filter(n > 0).select("_key", "_ord", F.transform(found, marked).alias("_runs"))
    own = lambda r: F.filter(F.slice("_runs", r["at"] + 1, min_lines), lambda q: q["fp_at"] == r["fp_at"])
    first = F.filter("_runs", lambda r: (r["at"] == 0) | (F.get("_runs", r["at"] - 1)["fp_at"] < r["fp_at"]))
    each = windows.select("_key", "_ord", F.explode(F.transform(first, own)).alias("_own"))
    extents = F.transform(
        "_own",
        lambda r: F.struct(
            r["at"].alias("at"), field(r["part"], "i").alias("lines"),
            F.xxhash64(field(r["part"], "h")).alias("a"), F.xxhash64(F.lit(2), field(r["part"], "g")).alias("b"),
        ),
    )
    head = F.get("_own", F.lit(0))
    return each.select("_key", "_ord", head["fp_at"].alias("fp_at"), F.array_min(field(head["part"], "h")).alias("fp"), extents.alias("runs"))


def later_lines(rows: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """_key, _ord and _gone (numbers of the lines to delete) of the rows (_key, _ord, _text) that lose any."""
    every = materialize(fingerprints(rows, min_lines, min_words), "fingerprints")
    place = F.struct("_key", "_ord", "fp_at")
    prints = every.groupBy("fp").agg(F.min(place).alias("low"), F.max(place).alias("high"), F.count("*").alias("_n")).filter("low <> high").select("fp", "_n")
    met = materialize(fair_join(every, materialize(prints, "prints"), ["fp"], "left_semi", every.count()), "met-places")
    extended = met.select("_key", "_ord", F.inline("runs"))
    start = F.struct("_key", "_ord", "at")
    first = extended.groupBy("a", "b").agg(F.min(start).alias("first"), F.max(start).alias("last"), F.count("*").alias("_n")).filter("first <> last").drop("last")
    total = met.agg(F.sum(F.size("runs"))).first()[0] or 0
    later = fair_join(extended, materialize(first, "first-runs"), ["a", "b"], "inner", total).filter(F.struct("_key", "_ord", "at") > F.col("first"))
    # a partial aggregate: overlapping runs of a document meet here
    return later.select("_key", "_ord", F.explode("lines").alias("i")).groupBy("_key", "_ord").agg(F.collect_set("i").alias("_gone"))


def _joined(docs: DataFrame, id_col: str, text_col: str, min_lines: int, min_words: int, keep: bool) -> DataFrame:
    rows, _ = keyed(docs, id_col, text_col, keep)
    gone = later_lines(rows.select("_key", "_ord", "_text"), min_lines, min_words)
    return rows.join(gone, ["_key", "_ord"], "left")


def _kept():
    lines = _split(F.col("_text"))
    numbers = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_gone"))
    return F.when(F.col("_gone").isNull(), F.col("_text").cast("string")).otherwise(F.array_join(F.transform(numbers, lambda i: F.get(lines, i)), "\n"))


def dedup_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """id_col, n_lines, n_removed, n_runs (maximal deleted runs of lines that follow each other, blank ones passed over not
    counted in) and kept_sha256 (of the remaining lines) of every row."""
    out = _joined(docs, id_col, text_col, min_lines, min_words, False)
    gone = F.coalesce(F.col("_gone"), F.array().cast("array<int>"))
    lines = _split(F.col("_text"))
    starts = F.size(F.array_except(gone, F.transform(gone, lambda i: i + 1)))
    return out.select(
        id_of("_key").alias(id_col), F.size(lines).cast("long").alias("n_lines"), F.size(gone).cast("long").alias("n_removed"),
        starts.cast("long").alias("n_runs"), F.sha2(_kept().cast("binary"), 256).alias("kept_sha256"),
    )


def without_later_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """docs, all columns, with the lines of later repeated runs deleted from text_col (a null text becomes empty)."""
    out = _joined(docs, id_col, text_col, min_lines, min_words, True)
    kept = _kept().alias(text_col)
    return out.select(*[kept if c == text_col else F.col(f"_row.`{c}`") for c in docs.columns])
