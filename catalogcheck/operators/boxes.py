"""Boxes on pages: overlap joins on a grid, words inside cells, predicted against gold boxes, and gold boxes verified on words.

An overlap join files every box under each cell of a grid that it touches, joins on page and cell, and keeps a pair only
in the cell of the upper left corner of what the two share: each pair once, without removing duplicates, and with no
inequality joined alone. Coordinates that must be equal are compared as whole hundredths, rounded half to even.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import tables as T

#: Width and height of a grid cell: some words wide, some lines high.
CELL = (120.0, 60.0)
SPACE = "[ \\t\\n\\r\\f\\x0B]+"
SIDES = ("x0", "y0", "x1", "y1")


def hundredths(c: Column) -> Column:
    return F.bround(c * 100).cast("long")


def filed(boxes: DataFrame, cell: tuple[float, float] = CELL) -> DataFrame:
    """Every box once for each grid cell (cx, cy) that it touches."""

    def span(low: str, high: str, size: float) -> Column:
        return F.sequence(F.floor(F.col(low) / size), F.floor(F.greatest(low, high) / size))

    out = boxes.withColumn("cx", F.explode(span("x0", "x1", cell[0])))
    return out.withColumn("cy", F.explode(span("y0", "y1", cell[1])))


def shared_area(a: dict[str, Column], b: dict[str, Column]) -> Column:
    wide = F.greatest(F.lit(0.0), F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]))
    high = F.greatest(F.lit(0.0), F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]))
    return wide * high


def area(a: dict[str, Column]) -> Column:
    return (a["x1"] - a["x0"]) * (a["y1"] - a["y0"])


def sides(prefix: str = "") -> dict[str, Column]:
    return {s: F.col(prefix + s) for s in SIDES}


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], cell: tuple[float, float] = CELL) -> DataFrame:
    """Pairs of boxes of one page that share area: left columns, right columns (sides as r_x0 ...), ``shared`` and left's ``area``."""
    r = right.withColumnsRenamed({s: f"r_{s}" for s in SIDES})
    r = filed(r.withColumns({s: F.col(f"r_{s}") for s in SIDES}), cell).drop(*SIDES)
    both = filed(left, cell).join(r, [*keys, "cx", "cy"])
    here = (F.floor(F.greatest("x0", "r_x0") / cell[0]) == F.col("cx")) & (F.floor(F.greatest("y0", "r_y0") / cell[1]) == F.col("cy"))
    out = both.filter(here).withColumns({"shared": shared_area(sides(), sides("r_")), "area": area(sides())})
    return out.filter("shared > 0").drop("cx", "cy")


def words_in_boxes(words: DataFrame, boxes: DataFrame, keys: list[str], least: float = 0.5) -> DataFrame:
    """Words of which at least that share of the own area lies inside a box."""
    return overlapping(words, boxes, keys).withColumn("share", F.col("shared") / F.col("area")).filter(F.col("share") >= least)


def iou(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Shared area over joint area; 0 where either box has none."""
    shared = shared_area(a, b)
    return F.when((area(a) <= 0) | (area(b) <= 0), 0.0).otherwise(shared / (area(a) + area(b) - shared))


def best_iou(box: Column, gold: Column) -> Column:
    """The largest overlap of one box (struct) with any of an array of them; 0 without any."""
    one = {s: box[s] for s in SIDES}
    return F.coalesce(F.array_max(F.transform(gold, lambda g: iou(one, {s: g[s] for s in SIDES}))), F.lit(0.0))


def gold_verified(annotations: DataFrame, words: DataFrame) -> DataFrame:
    """annotations (record_id, doc_id, page, boxes, value) with what is wrong with each: ``problem``, null if nothing.

    Each box has to be the box of a word (doc_id, page, pos, word and sides) of that page, and the words in the boxes, in
    reading order, have to spell the value. One exchange by page and box; what is gathered is one annotation's words.
    """
    spot = [hundredths(F.col(f"box.{s}")).alias(s) for s in SIDES]
    wanted = annotations.select("record_id", "doc_id", "page", F.explode("boxes").alias("box")).select("record_id", "doc_id", "page", *spot).distinct()
    seen = words.select("doc_id", "page", "pos", "word", *(hundredths(F.col(s)).alias(s) for s in SIDES))
    met = wanted.join(seen, ["doc_id", "page", *SIDES], "left").groupBy("record_id").agg(
        F.count_if(F.col("word").isNull()).alias("strange"), F.array_sort(F.collect_list(F.when(F.col("word").isNotNull(), F.struct("pos", "word")))).alias("found")
    )
    known = words.select("doc_id").distinct().withColumn("present", F.lit(True))
    out = annotations.join(met, "record_id", "left").join(known, "doc_id", "left")
    spelled = F.coalesce(F.transform("found", lambda w: w["word"]), F.array().cast("array<string>"))
    claimed = F.filter(F.split("value", SPACE), lambda w: w != "")
    problem = F.when(F.col("present").isNull(), "document_absent").when(F.col("strange") > 0, "box_not_a_word").when(spelled != claimed, "spells_otherwise")
    return out.select("record_id", "doc_id", "page", F.size("boxes").alias("boxes"), F.coalesce("present", F.lit(False)).alias("present"), problem.alias("problem"))


def word_boxes(docs: DataFrame) -> DataFrame:
    """doc_id, page, line, pos, word and box of the words of a document; coordinates have two decimals."""
    w = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), SPACE)).alias("pos", "word")).filter("word <> ''")
    line = F.floor(F.pmod("pos", F.lit(200)) / 10)
    x0, y0 = F.pmod("pos", F.lit(10)) * 5000 + F.pmod(F.col("pos") * 37, F.lit(100)), line * 1200 + F.pmod(F.col("pos") * 13, F.lit(100))
    x1, y1 = x0 + 400 * F.length("word") + 25, y0 + 1000
    page = F.floor(F.col("pos") / 200).cast("int")
    return w.select("doc_id", page.alias("page"), line.cast("int").alias("line"), "pos", "word", *((c / 100.0).cast("double").alias(s) for s, c in zip(SIDES, (x0, y0, x1, y1), strict=True)))


def annotations(words: DataFrame) -> DataFrame:
    """Annotated values of one to three words of a page; some have a shifted box, another value, coordinates off by less than
    a hundredth, or a document that isn't there."""
    w = words.select("*", F.explode(F.array(*(F.lit(k) for k in range(3)))).alias("k")).withColumn("start", F.col("pos") - F.col("k"))
    w = w.filter((F.col("start") >= 0) & (F.pmod(7 * F.col("start") + F.col("doc_id"), F.lit(50)) == 0) & (F.col("k") <= F.pmod("start", F.lit(3))) & (F.floor(F.col("start") / 200) == F.col("page")))
    kind = F.pmod(F.col("doc_id") + 3 * F.col("start"), F.lit(17))
    move = {s: F.when((kind == 0) & (F.col("k") == 0), by).when(kind == 2, 0.004).otherwise(0.0) for s, by in zip(SIDES, (0.5, 0.25, 0.5, 0.25), strict=True)}
    w = w.withColumns({"kind": kind, "box": F.struct(*((F.col(s) + move[s]).alias(s) for s in SIDES))})
    rows = w.groupBy("doc_id", "start", "kind").agg(F.min("page").alias("page"), F.collect_list("box").alias("boxes"), F.array_sort(F.collect_list(F.struct("pos", "word"))).alias("own"))
    value = F.concat(F.array_join(F.transform("own", lambda x: x["word"]), "  "), F.when(F.col("kind") == 1, " extra").otherwise(""))
    doc = F.when(F.col("kind") == 3, -F.col("doc_id") - 1).otherwise(F.col("doc_id"))
    return rows.select(F.concat_ws("-", F.col("doc_id").cast("string"), F.col("start").cast("string")).alias("record_id"), doc.alias("doc_id"), "page", "boxes", value.alias("value"))


def line_cells(words: DataFrame) -> DataFrame:
    """Two cells over each line of words, whose edges cut through some of them."""
    lines = words.select("doc_id", "page", "line").distinct().select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("cell"))
    x0 = (F.col("cell") * 240 + F.col("line") % 5 * 7).cast("double")
    return lines.select("doc_id", "page", F.col("line").alias("cell_line"), "cell", x0.alias("x0"), (F.col("line") * 12 + 2.0).alias("y0"), (x0 + 230).alias("x1"), (F.col("line") * 12 + 12.0).alias("y1"))


def _words(s, d) -> DataFrame:
    return word_boxes(T.table(s, d, "documents"))


def join_words_in_box(s, d) -> DataFrame:
    """For each cell, its words and how much of them lies inside, in ten-thousandths."""
    w = _words(s, d)
    hits = words_in_boxes(w, line_cells(w), ["doc_id", "page"])
    return hits.groupBy("doc_id", "page", "cell_line", "cell").agg(F.count("*").alias("words"), F.min("pos").cast("long").alias("first"), F.sum(F.bround(F.col("share") * 10000).cast("long")).alias("inside"))


def join_iou_match(s, d, least: float = 0.5) -> DataFrame:
    """The best overlap of each predicted box with any gold box of its field: sizes differ, and both axes are shifted."""
    e = T.view(s, d, "fx_eval")
    wide, high = 40.0 + F.col("h") % 5 * 10, 10.0 + F.col("h") % 3 * 4

    def box(x, y, w, h):
        return F.struct(x.alias("x0"), y.alias("y0"), (x + w).alias("x1"), (y + h).alias("y1"))

    x, y = F.col("gx0"), F.col("gy0")
    gold = F.array(box(x, y, wide, high), box(x + 200, y + F.col("h") % 2 * 15, wide / 2, high))
    drawn = box(x + F.col("shift") * 8 + F.when(F.col("h") % 10 == 0, 200.0).otherwise(0.0), y + F.col("h") % 4 * 3, wide * F.when(F.col("h") % 12 == 5, 0.0).otherwise(1.0), high)
    over = F.when(~F.col("abstained"), F.round(best_iou(drawn, gold), 6))
    return e.select("id", over.alias("iou"), F.coalesce(over >= least, F.lit(False)).alias("grounded"))


QUERIES = {
    "join_gold_verify": lambda s, d: (lambda w: gold_verified(annotations(w), w))(T.written(_words(s, d), "words")),
    "join_words_in_box": join_words_in_box,
    "join_iou_match": join_iou_match,
}

_B = r"""w0 AS (SELECT doc_id, unnest(regexp_split_to_array(coalesce(text, ''), '[ \t\n\r\f\x0B]+')) AS word, generate_subscripts(regexp_split_to_array(coalesce(text, ''), '[ \t\n\r\f\x0B]+'), 1) - 1 AS pos FROM documents),
w1 AS (SELECT doc_id, pos, word, CAST(pos // 200 AS INT) AS page, CAST(pos % 200 // 10 AS INT) AS line, pos % 10 * 5000 + pos * 37 % 100 AS x, pos % 200 // 10 * 1200 + pos * 13 % 100 AS y FROM w0 WHERE word <> ''),
w AS (SELECT doc_id, page, line, pos, word, CAST(x AS DOUBLE) / 100 AS x0, CAST(y AS DOUBLE) / 100 AS y0, CAST(x + 400 * length(word) + 25 AS DOUBLE) / 100 AS x1, CAST(y + 1000 AS DOUBLE) / 100 AS y1 FROM w1)"""
_H = ", ".join(f"CAST(round_even({{0}}{s} * 100, 0) AS BIGINT) AS {{1}}{s}" for s in SIDES)
_SHARED = "greatest(0.0::DOUBLE, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0.0::DOUBLE, least(a.y1, b.y1) - greatest(a.y0, b.y0))"

ORACLES = {
    "join_gold_verify": f"""WITH {_B}, p AS (SELECT *, pos - k AS start, (doc_id + 3 * (pos - k)) % 17 AS kind FROM w, (VALUES (0), (1), (2)) t(k) WHERE pos >= k AND (7 * (pos - k) + doc_id) % 50 = 0 AND k <= (pos - k) % 3 AND (pos - k) // 200 = page),
a AS (SELECT doc_id AS origin, start, kind, page, pos, word, k, {", ".join(f"{s} + CASE WHEN kind = 0 AND k = 0 THEN {by} WHEN kind = 2 THEN 0.004::DOUBLE ELSE 0 END AS {s}" for s, by in zip(SIDES, ("0.5::DOUBLE", "0.25::DOUBLE") * 2, strict=True))} FROM p),
r AS (SELECT concat(origin, '-', start) AS record_id, CASE WHEN any_value(kind) = 3 THEN -origin - 1 ELSE origin END AS doc_id, min(page) AS page, CAST(count(*) AS INT) AS boxes, string_agg(word, ' ' ORDER BY pos) || CASE WHEN any_value(kind) = 1 THEN ' extra' ELSE '' END AS value FROM a GROUP BY origin, start),
b AS (SELECT DISTINCT record_id, r.doc_id, r.page, {_H.format("a.", "")} FROM r JOIN a ON record_id = concat(origin, '-', start)),
q AS (SELECT doc_id, page, pos, word, {_H.format("", "")} FROM w),
m AS (SELECT record_id, count_if(word IS NULL) AS strange, coalesce(string_agg(word, ' ' ORDER BY pos), '') AS spelled FROM b LEFT JOIN q USING (doc_id, page, x0, y0, x1, y1) GROUP BY 1)
SELECT record_id, doc_id, page, boxes, doc_id IN (SELECT doc_id FROM w) AS present, CASE WHEN doc_id NOT IN (SELECT doc_id FROM w) THEN 'document_absent' WHEN strange > 0 THEN 'box_not_a_word' WHEN spelled <> value THEN 'spells_otherwise' END AS problem FROM r JOIN m USING (record_id)""",
    "join_words_in_box": f"""WITH {_B}, b AS (SELECT doc_id, page, line, cell, CAST(cell * 240 + line % 5 * 7 AS DOUBLE) AS x0, CAST(line * 12 + 2 AS DOUBLE) AS y0, CAST(cell * 240 + line % 5 * 7 + 230 AS DOUBLE) AS x1, CAST(line * 12 + 12 AS DOUBLE) AS y1 FROM (SELECT DISTINCT doc_id, page, line FROM w), (VALUES (0), (1)) c(cell)),
s AS (SELECT b.doc_id, b.page, b.line AS cell_line, cell, pos, {_SHARED} / ((a.x1 - a.x0) * (a.y1 - a.y0)) AS share FROM w a JOIN b ON a.doc_id = b.doc_id AND a.page = b.page AND b.line BETWEEN a.line - 1 AND a.line + 1)
SELECT doc_id, page, cell_line, cell, count(*) AS words, min(pos) AS first, CAST(sum(CAST(round_even(share * 10000, 0) AS BIGINT)) AS BIGINT) AS inside FROM s WHERE share >= 0.5 GROUP BY ALL""",
    "join_iou_match": T.with_views(f"""WITH e AS (SELECT id, abstained, shift, h, gx0 AS x, gy0 AS y, CAST(40 + h % 5 * 10 AS DOUBLE) AS wide, CAST(10 + h % 3 * 4 AS DOUBLE) AS high FROM fx_eval),
a AS (SELECT id, abstained, x + shift * 8 + CASE WHEN h % 10 = 0 THEN 200 ELSE 0 END AS x0, y + h % 4 * 3 AS y0, x + shift * 8 + CASE WHEN h % 10 = 0 THEN 200 ELSE 0 END + wide * CASE WHEN h % 12 = 5 THEN 0 ELSE 1 END AS x1, y + h % 4 * 3 + high AS y1 FROM e),
b AS (SELECT id, x AS x0, y AS y0, x + wide AS x1, y + high AS y1 FROM e UNION ALL SELECT id, x + 200, y + h % 2 * 15, x + 200 + wide / 2, y + h % 2 * 15 + high FROM e),
o AS (SELECT a.id, any_value(abstained) AS abstained, max(CASE WHEN a.x1 <= a.x0 THEN 0 ELSE {_SHARED} / ((a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) - {_SHARED}) END) AS best FROM a JOIN b USING (id) GROUP BY 1)
SELECT id, CASE WHEN NOT abstained THEN round(best, 6) END AS iou, coalesce(CASE WHEN NOT abstained THEN round(best, 6) >= 0.5 END, false) AS grounded FROM o"""),
}
