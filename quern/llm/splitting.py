"""Splitting oversized texts at natural boundaries with one bounded-quantifier pattern."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE_ENDS = r"(?U)^\s+|\s+$"


def piece_pattern(room: int) -> str:
    """Consumes a text in segments of at most `room` characters: to its end, else up to the strongest boundary in reach (blank line, line end, sentence end, white space), else `room` characters. The stronger kinds must leave a segment at least an eighth full, so that a heading does not become a piece of its own."""
    least = max(1, room // 8)
    kinds = [r"(?<=\n[ \t\r]{0,20}\n)(?=[^\r\n])", r"(?<=[\r\n])(?=\S)", r"(?<=[.!?]\s{1,8})(?=\S)"]
    ordered = [f".{{1,{room}}}\\z", *(f".{{{least},{room}}}{k}" for k in kinds), f".{{1,{room}}}(?<=\\s)(?=\\S)", f".{{1,{room}}}"]
    return "(?sU)" + "|".join(ordered)


KINDS = ("paragraph", "line", "sentence", "word", "none")


def weakest_cut(cuts: Column) -> Column:
    """The place in KINDS of the weakest boundary that the pieces (all but the last) end at: every unit of that kind lies within a piece, so the text's own boundary is no weaker."""
    place = F.create_map(*(F.lit(x) for i, k in enumerate(("paragraph", "line", "sentence", "word", "character")) for x in (k, i)))
    return F.coalesce(F.array_max(F.transform(F.filter(cuts, lambda c: c != "end"), lambda c: F.element_at(place, c))), F.lit(0))


def boundary_of(text: Column, limit: int, weakest: Column) -> Column:
    """The first of KINDS at which every unit, trimmed, has at most `limit` characters: the kinds stronger than `weakest`, which the pieces gave, are tested exactly, and where none of them holds it is `weakest`.

    A text that had to be cut inside a word can still fit by words, as pieces
    are shorter than `limit`; for all kinds the exact test comes after the pieces.
    """

    def fits(units: Column) -> Column:
        return ~F.exists(units, lambda u: F.length(F.regexp_replace(u, SPACE_ENDS, "")) > limit)

    lines = F.split(text, r"\r\n|\n|\r")
    sentences = F.split(text, r"(?U)(?<=[.!?])\s+|[\r\n]+")
    paragraphs = F.split(text, r"(?U)(?>\r\n|\n|\r)(?:[\s&&[^\r\n]]*(?>\r\n|\n|\r))+")
    units = (paragraphs, lines, sentences, F.split(text, r"(?U)\s+"))
    found = F.when(weakest == 0, KINDS[0])
    for i, u in enumerate(units):
        found = found.when((weakest > i) & fits(u), KINDS[i]).when(weakest == i + 1, KINDS[i + 1])
    return found


def split_oversized(df: DataFrame, key: str = "id", text: str = "text", carry: tuple[str, ...] = ("section",), limit: int = 1600, overlap: int = 200) -> DataFrame:
    """One row per piece: key, the carried columns, piece_no (from 0), start (offset of the piece's new part), piece, cut, boundary.

    A text of at most `limit` characters (code points) is one piece with cut
    `end` and a null boundary. A longer one is cut by `piece_pattern` into
    segments of at most limit - overlap characters, and every piece after the
    first repeats up to `overlap` characters of the piece before, from a word
    start where the stretch has one. The segments joined give the text
    again. `cut` tells where a piece ends; `boundary` is the strongest kind of
    boundary by which the whole text falls into units within the limit, found
    from the cuts (`weakest_cut`) and an exact test of the stronger kinds.
    Null texts give no row and empty ones one empty piece; null keys are kept;
    rows that repeat a key with the same text count once (the
    smallest carried values stay); carried columns keep their names, and other
    columns are ignored.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be smaller than limit")
    held = F.struct(*(F.col(c).alias(f"c{i}") for i, c in enumerate(carry))) if carry else F.lit(None)
    rows = df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"), held.alias("held")).where("t is not null")
    long = F.length("t") > limit
    rows = rows.groupBy("k", "t").agg(F.min("held").alias("held"))
    segments = F.when(long, F.regexp_extract_all("t", F.lit(piece_pattern(limit - overlap)), F.lit(0))).otherwise(F.array("t"))
    rows = rows.select("k", "held", "t", segments.alias("s")).withColumn("cuts", F.transform("s", lambda x, i: F.when(i == F.size("s") - 1, "end").otherwise(_cut(x))))
    rows = rows.withColumn("weakest", weakest_cut(F.col("cuts")))
    boundary = F.when(long, boundary_of(F.col("t"), limit, F.col("weakest")))
    ends = F.aggregate("s", F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + F.length(x))))
    rows = rows.select("k", "held", "s", "cuts", boundary.alias("boundary"), ends.alias("starts"))
    rows = rows.select("k", "held", "boundary", F.posexplode(F.arrays_zip("s", "cuts", F.slice("starts", 1, F.size("s")).alias("start"), F.concat(F.array(F.lit("")), F.slice("s", 1, F.size("s") - 1)).alias("before"))).alias("piece_no", "p"))
    back = F.expr(f"right(p.before, {overlap})")
    back = F.when(back.rlike(r"(?U)\s\S"), F.regexp_replace(back, r"(?U)^\S*\s+", "")).otherwise(back)
    if overlap == 0:
        back = F.lit("")
    return rows.select(F.col("k").alias(key), *(F.col(f"held.c{i}").alias(c) for i, c in enumerate(carry)), "piece_no", F.col("p.start").alias("start"), F.concat(back, F.col("p.s")).alias("piece"), F.col("p.cuts").alias("cut"), "boundary")


def _cut(s: Column) -> Column:
    """What a segment ends at."""
    return (
        F.when(s.rlike(r"\n[ \t\r]*\n\s*$"), "paragraph")
        .when(s.rlike(r"[\r\n]\s*$"), "line")
        .when(s.rlike(r"(?U)[.!?]\s+$"), "sentence")
        .when(s.rlike(r"(?U)\s$"), "word")
        .otherwise("character")
    )
