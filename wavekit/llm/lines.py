"""Line deduplication by content-defined chunks of lines (DataFrame operations only)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavekit.llm.common import cut, whole_text

#: A line of at least so many words is a chunk of its own.
LONG_LINE = 20
_N = 1 << 32


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once per row."""
    return F.transform(F.array(value), use)[0]


def _is_long(line: Column, long_line: int) -> Column:
    """At least so many words, counted by the spaces between them."""
    return F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) >= long_line - 1


def _chunks(lines: Column, long_line: int) -> Column:
    """Chunks of an array of lines as numbers start · 2³² + length. A pair of neighbouring lines has the rolling hash
    31 · h(line i-1) + h(line i) modulo 2³² of the line hashes; a chunk ends between the two lines of a pair whose hash is
    smaller than those of the pairs before and behind it, so no two boundaries are one line apart and a boundary depends
    on the four lines around it alone: lines put in or taken out elsewhere do not move it. A long line is a chunk of its
    own."""

    def edges(pairs: Column, long: Column) -> Column:
        n = F.size(lines)

        def ends(i: Column) -> Column:
            here = F.get(pairs, i - 1)
            lowest = (i > 1) & (here < F.get(pairs, i - 2)) & (here < F.get(pairs, i))
            return (i < n) & (F.coalesce(lowest, F.lit(False)) | F.get(long, i) | F.get(long, i - 1))

        return F.concat(F.array(F.lit(0)), F.filter(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), ends), F.array(n))

    def pair_hashes(h: Column) -> Column:
        both = F.zip_with(F.slice(h, 1, F.greatest(F.size(h) - 1, F.lit(0))), F.slice(h, 2, F.size(h)), lambda x, y: (x * 31 + y) % _N)
        return F.when(F.size(h) > 1, both).otherwise(F.array().cast("array<bigint>"))

    def chunk(e: Column) -> Column:
        code = lambda k: F.get(e, k).cast("long") * _N + F.get(e, k + 1) - F.get(e, k)
        return F.transform(F.sequence(F.lit(0), F.size(e) - 2), code)

    line_hash = F.transform(lines, lambda x: F.conv(F.substring(F.md5(x), 1, 8), 16, 10).cast("long"))
    long = F.transform(lines, lambda x: _is_long(x, long_line))
    both = F.struct(_once(line_hash, pair_hashes).alias("pairs"), long.alias("long"))
    return _once(_once(both, lambda b: edges(b["pairs"], b["long"])), chunk)


def _start(code: Column) -> Column:
    return F.shiftright(code, 32).cast("int")


def _length(code: Column) -> Column:
    return (code % _N).cast("int")


def _lines_of(lines: Column, code: Column) -> Column:
    return F.array_join(F.slice(lines, _start(code) + 1, _length(code)), "\n")


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = 2, long_line: int = LONG_LINE
) -> DataFrame:
    """Remove every chunk of at least ``min_lines`` lines, and every line of at least ``long_line`` words, that occurs before
    in the corpus.

    Returns one row per input row: ``<id_col>, n_lines, n_removed, kept`` (the kept chunks, joined by line feeds;
    empty if nothing is left). Of a repeated chunk the occurrence with the smallest (id, null last; then hash of
    the text; then place) stays. Lines end at line feeds and keep all other characters; null text counts as empty
    and has one empty line. Rows that repeat an id and a text are one document and get the same result. Extra
    columns are ignored; an empty table gives an empty table.

    Chunks are compared byte by byte: they are grouped by their text itself (partially aggregated before the
    shuffle, so a chunk in a third of all rows travels once per map task). Occurrences then find their group by a
    128-bit hash; keys that two different texts share are left alone. Texts travel twice: in that grouping and to
    the documents' removals.
    """
    text = whole_text(text_col)
    base = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("tkey"))
    lines = F.split("text", "\n", -1)

    def long_chunks(x: Column) -> Column:
        some = F.filter(_chunks(x, long_line), lambda c: (_length(c) >= min_lines) | _is_long(F.get(x, _start(c)), long_line))
        return F.transform(some, lambda c: F.struct(c.alias("code"), _lines_of(x, c).alias("chunk")))

    found = base.select("id", "tkey", F.explode(_once(lines, long_chunks)).alias("c")).select(
        F.struct(F.col("id").isNull().alias("z"), "id", "tkey", "c.code").alias("place"),
        F.xxhash64("c.chunk").alias("h"), F.xxhash64(F.lit("second"), "c.chunk").alias("g"), "c.chunk",
    )
    groups = (
        found.groupBy("h", "g", "chunk")
        .agg(F.count("*").alias("n"), F.min("place").alias("first"))
        .groupBy("h", "g")
        .agg(F.count("*").alias("texts"), F.max("n").alias("n"), F.min("first").alias("first"))
        .where("texts = 1 and n > 1")
    )
    gone = (
        found.select("h", "g", "place")
        .join(cut(groups.select("h", "g", "first")), ["h", "g"])
        .where(~F.col("place").eqNullSafe(F.col("first")))
        .groupBy(F.col("place.id").alias("__id"), F.col("place.tkey").alias("__tkey"))
        .agg(F.collect_set("place.code").alias("gone"))
    )
    joined = base.join(gone, F.col("id").eqNullSafe(F.col("__id")) & (F.col("tkey") == F.col("__tkey")), "left")

    def rest(x: Column) -> Column:
        def put_together(kept: Column) -> Column:
            return F.struct(
                F.array_join(F.transform(kept, lambda c: _lines_of(x, c)), "\n").alias("kept"),
                F.aggregate(kept, F.lit(0), lambda a, c: a + _length(c)).alias("n"),
            )

        return _once(F.array_except(_chunks(x, long_line), F.col("gone")), put_together)

    n_lines = F.size(lines)
    whole = F.struct(F.col("text").alias("kept"), n_lines.alias("n"))
    return joined.select(
        "id", n_lines.alias("n_lines"), F.when(F.col("gone").isNull(), whole).otherwise(_once(lines, rest)).alias("r")
    ).select(F.col("id").alias(id_col), "n_lines", (F.col("n_lines") - F.col("r.n")).alias("n_removed"), F.col("r.kept").alias("kept"))
