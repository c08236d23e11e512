"""Main body of pages: tree scoring of lines, containers and the page, in SQL."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, join_dimension
from .repeated_lines import clean_line, line_array, repeated_lines

#: What stands in so many documents and in one of so many counts as a template of all sources.
LEAST_DOCS, ONE_IN = 5, 2_000
#: A light line has less than one point: no comma, no sentence, fewer characters than this.
LIGHT = 150
#: A last line of at least so many characters that begins a standing line of the source is that line, cut off.
CUT = 5
#: A sibling of the best container is kept if it has at least this many points, or as many as the best.
SIBLING = 1.0
_HEAD = r"(?:[^\n]*[›»>→]|[^\n:–—]*[:–—]) "
#: The end of a sentence within a line: three letters, a stop, and a new beginning.
_INNER = r"""[.!?…](?<=\p{L}{3}[.!?…])["”“»)’']* ["„“«(–—]*[\p{Lu}(–—]"""


def _masked(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[0-9]+", "0")


def _head(masked: Column) -> Column:
    """What ``_HEAD`` finds, searched only where one of its marks stands before a blank."""
    return F.when(reduce(or_, [masked.contains(f"{x} ") for x in "›»>→:–—"]), F.regexp_extract(masked, rf"^({_HEAD})", 1)).otherwise("")


def _last(line: Column, marks: str) -> Column:
    """Whether the last character is one of ``marks``."""
    return reduce(or_, [line.endswith(x) for x in marks])


def _ends(line: Column, marks: str) -> Column:
    """Whether a line ends with one of ``marks``, perhaps within quotation marks or brackets."""
    closing = "\"”“»)’'"
    return F.when(_last(line, closing), _last(F.rtrim(line, F.lit(closing)), marks)).otherwise(_last(line, marks))


def _spaces(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit(" ")))


def points(line: Column) -> Column:
    """What a line earns: 1 for a sentence (four words that end with a stop, or one that begins after another), 1 for each comma, up to 3 for its length."""
    sentence = (_ends(line, ".!?…") & (_spaces(line) >= 3)) | line.rlike(_INNER)
    return F.when(sentence, 1.0).otherwise(0.0) + F.length(line) - F.length(F.replace(line, F.lit(","))) + F.least(F.lit(3.0), F.length(line) / LIGHT)


def _open(line: Column) -> Column:
    """Short and without a stop at its end, or of three words at most: what may be a link, a label or a counter."""
    return (F.length(line) < LIGHT) & (~_last(line, ".!?…") | (_spaces(line) < 3))


def _light(line: Column) -> Column:
    return (F.length(line) < LIGHT) & ~_last(line, ".!?…") & ~line.contains(",")


def page_templates(docs: DataFrame) -> DataFrame:
    """(key, digits, head, list) of what light lines of many documents have in common, whatever their source.

    ``docs`` has text. ``digits``: lines that differ in their digits only (counters, times). ``head``:
    beginnings up to a colon, dash or arrow that are followed by ever other words without a comma
    (labels of links, the path of a page), unless a list with commas follows more often (casts).
    ``list``: lines that two more light lines follow in at least half of their documents (headings of
    lists, menus). Each stands in at least ``LEAST_DOCS`` documents and one in ``ONE_IN``; so of each kind
    there are at most ``lines a document * ONE_IN``. Keys are 64-bit hashes, case ignored.
    """
    n = docs.count()
    least = max(LEAST_DOCS, -(-n // ONE_IN))
    lines = docs.where("text <> ''").select(F.monotonically_increasing_id().alias("row"), F.filter(line_array(F.col("text")), lambda x: x != "").alias("l"))
    three = F.arrays_zip("l", F.slice("l", 2, F.greatest(F.size("l"), F.lit(1))).alias("m"), F.slice("l", 3, F.greatest(F.size("l"), F.lit(1))).alias("n"))
    each = lines.select("row", F.explode(three).alias("x")).select("row", "x.l", "x.m", "x.n").where(_open(F.col("l")))
    each = each.select("row", _masked(F.col("l")).alias("line"), _light(F.col("l")).alias("light"), F.coalesce(_light(F.col("l")) & _light(F.col("m")) & _light(F.col("n")), F.lit(False)).alias("listed"))
    each = each.withColumn("head", _head(F.col("line")))
    kinds = F.array(
        F.struct(F.when(F.col("light"), "line").alias("kind"), F.col("line").alias("key")), F.struct(F.when(F.col("listed"), "list").alias("kind"), F.col("line").alias("key")), F.struct(F.when(F.col("line").contains("0"), "digits").alias("kind"), F.col("line").alias("key")),
        F.struct(F.when(F.col("head") != "", F.when(F.col("light"), "head").when(F.col("line").contains(","), "comma")).alias("kind"), F.col("head").alias("key")),
    )
    once = each.select("row", F.explode(kinds).alias("k")).where("k.kind is not null").select("row", "k.kind", F.xxhash64("k.key").alias("key")).distinct()
    often = once.groupBy("key").agg(*[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("digits", "head", "comma", "list", "line")])
    is_ = {"digits": F.col("n_digits") >= least, "head": (F.col("n_head") >= least) & (F.col("n_head") >= F.col("n_comma")), "list": (F.col("n_list") >= least) & (F.col("n_list") * 2 >= F.col("n_line"))}
    return often.select("key", *[c.alias(k) for k, c in is_.items()]).where("digits or head or list")


def standing_lines(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(source, line_key) of the repeated lines of each source, and (source, start_key) of all their beginnings of ``CUT`` characters and more."""
    lines = cut(repeated_lines(docs, 1))
    begin = F.transform(F.sequence(F.lit(CUT), F.length("line")), lambda i: F.substring(F.col("line"), F.lit(1), i))
    starts = lines.where(F.length("line") >= CUT).select("source", F.explode(begin).alias("start")).select("source", F.xxhash64("start").alias("start_key")).distinct()
    return lines.select("source", F.xxhash64("line").alias("line_key")), starts


def scored_lines(articles: DataFrame, fields: tuple[str, ...] = ("full_text", "first_paragraph"), key: str = "id", lines_from: str = "full_text") -> DataFrame:
    """(key, field, text_hash, line_no, own) of every non-blank line.

    Lines are the leaves of a tree: page, containers, lines. A line earns ``points`` for sentences,
    commas and length, less its link density, which is 1 for standing lines of the source, for what
    ``page_templates`` knows and for lines of one sentence or two that name their source. Light lines
    that ask nothing, in a run of three, or of two after a page line, or after a heading of lists are a list of links,
    density 1, too. Lines between page lines form a container and pass it their
    points. The container with most points is the body; siblings with at least ``SIBLING`` points are
    kept, and light ones (subheads, short questions) between kept ones. If none has points, all are.
    """
    d = articles.select(F.col(key).alias("key"), "source", *[F.col(f).alias(f"field_{i}") for i, f in enumerate(fields)], F.col(lines_from).alias("from_text"))
    known, starts = standing_lines(d.select(F.col("key").alias("id"), "source", F.col("from_text").alias("text")))
    templates = cut(page_templates(d.select(F.col("from_text").alias("text"))))
    rows = F.array(*[F.struct(F.lit(i).alias("field"), F.col(f"field_{i}").alias("text")) for i in range(len(fields))])
    each = d.withColumn("row", F.monotonically_increasing_id() * len(fields)).select("row", "key", "source", F.explode(rows).alias("r"))
    each = each.select((F.col("row") + F.col("r.field")).alias("row"), "key", "source", "r.field", F.xxhash64("r.text").alias("text_hash"), F.posexplode(line_array(F.col("r.text"))).alias("pos", "line")).where("line <> ''")
    line, at = F.col("line"), F.expr("instr(line, source)")
    around = F.expr("substring(line, instr(line, source) - 1, 1) || ' ' || substring(line, instr(line, source) + length(source), 1)")
    names_it = F.when((F.length("source") >= 4) & (at > 0), ~around.rlike(r"[\p{L}\p{N}]") & (F.size(F.split(line, _INNER)) <= 2))
    masked = F.when(_open(line), _masked(line))
    each = each.select(
        "row", "key", "source", "field", "text_hash", "pos", points(line).alias("points"), F.xxhash64("line").alias("line_key"), F.xxhash64(masked).alias("masked_key"), F.when(_light(line), F.xxhash64(_head(masked))).alias("head_key"),
        F.coalesce(masked.contains("0"), F.lit(False)).alias("has_digit"), _last(line, "?!").alias("asks"), F.coalesce(names_it, F.lit(False)).alias("names_it"),
    )
    each = join_dimension(each, known.withColumn("standing", F.lit(True)), ["source", "line_key"])
    each = join_dimension(each, known.groupBy("line_key").agg(F.count("*").alias("n")).where("n > 1").select("line_key", F.lit(True).alias("common")), "line_key")
    each = join_dimension(each, templates.where("digits or list").select(F.col("key").alias("masked_key"), "digits", "list"), "masked_key")
    each = join_dimension(each, templates.where("head").select(F.col("key").alias("head_key"), "head"), "head_key")
    each = join_dimension(each, starts.select("source", F.col("start_key").alias("line_key"), F.lit(True).alias("begins")), ["source", "line_key"])
    order, page = Window.partitionBy("row").orderBy("pos"), Window.partitionBy("row")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    light = F.col("points") < 1
    mark = yes("standing") | yes("common") | F.col("names_it") | (yes("digits") & F.col("has_digit")) | (light & (yes("head") | yes("list")))
    each = each.select("row", "key", "field", "text_hash", "pos", "points", mark.alias("mark"), yes("begins").alias("begins"), yes("list").alias("heads"), yes("head").alias("head"), "asks")
    each = each.withColumn("last", F.lead("pos").over(order).isNull()).withColumn("mark", F.col("mark") | (F.col("last") & F.col("begins")))
    each = each.withColumn("kind", F.when(light & (F.col("head") | ~F.col("mark") & ~F.col("asks")), 1).when(F.col("mark"), 0).otherwise(2))
    each = each.withColumns({"before": F.lag("kind").over(order), "headed": F.coalesce(F.lag("heads").over(order), F.lit(False))})
    each = each.withColumn("starts", ~F.col("kind").eqNullSafe(F.col("before"))).withColumn("run", F.sum(F.col("starts").cast("int")).over(order))
    run = Window.partitionBy("row", "run")
    each = each.withColumns({"length": F.count("*").over(run), "first_before": F.max(F.when(F.col("starts"), F.col("before"))).over(run), "first_headed": F.max(F.col("starts") & F.col("headed")).over(run)})
    listed = (F.col("kind") == 1) & ((F.col("length") >= 3) | ((F.col("length") >= 2) & (F.col("first_before") == 0)) | F.col("first_headed"))
    each = each.withColumn("linked", F.col("mark") | F.coalesce(listed, F.lit(False)))
    each = each.withColumn("container", F.sum(F.col("linked").cast("int")).over(order))
    each = each.withColumn("total", F.sum(F.when(~F.col("linked"), F.col("points"))).over(Window.partitionBy("row", "container")))
    each = each.withColumn("keeps", ~F.col("linked") & (F.col("total") >= F.least(F.lit(SIBLING), F.max("total").over(page))))
    each = each.withColumns({"from_pos": F.min(F.when(F.col("keeps"), F.col("pos"))).over(page), "to_pos": F.max(F.when(F.col("keeps"), F.col("pos"))).over(page)})
    cut_off = F.col("last") & (F.col("pos") > F.col("to_pos"))
    own = ~F.col("linked") & (F.col("pos").between(F.col("from_pos"), F.col("to_pos")) | cut_off)
    return each.select("key", F.element_at(F.array(*[F.lit(f) for f in fields]), F.col("field") + 1).alias("field"), "text_hash", (F.col("pos") + 1).alias("line_no"), own.alias("own"))


def own_lines(articles: DataFrame, fields: tuple[str, ...] = ("full_text", "summary"), key: str = "id", lines_from: str = "full_text") -> DataFrame:
    """(key, source, title, field, line_no, line, final) of the own lines, cleaned; ``final`` marks a field's last one. Repeated rows give one set of lines."""
    flags = scored_lines(articles, fields, key, lines_from).groupBy("key", "field", "text_hash", "line_no").agg(F.max("own").alias("own"))
    flags = flags.groupBy("key", "field", "text_hash").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "own"))), lambda x: x["own"]).alias("flags"))
    rows = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields])
    each = articles.select(F.col(key).alias("key"), "source", "title", F.explode(rows).alias("r")).select("key", "source", "title", "r.field", "r.text").where("text is not null").withColumn("text_hash", F.xxhash64("text"))
    f = flags.withColumnsRenamed({"key": "k", "field": "f", "text_hash": "h"})
    joined = each.join(f, each["key"].eqNullSafe(f["k"]) & (each["field"] == f["f"]) & (each["text_hash"] == f["h"]))
    lines = F.filter(F.arrays_zip(F.filter(line_array(F.col("text")), lambda x: x != "").alias("line"), F.col("flags").alias("own")), lambda x: x["own"])
    out = joined.select("key", "source", "title", "field", F.posexplode(lines).alias("line_no", "x"), F.size(F.filter("flags", lambda x: x)).alias("n"))
    return out.select("key", "source", "title", "field", "line_no", F.col("x.line").alias("line"), (F.col("line_no") == F.col("n") - 1).alias("final"))


def main_content(articles: DataFrame, fields: tuple[str, ...] = ("full_text", "first_paragraph"), key: str = "id", lines_from: str = "full_text") -> DataFrame:
    """(key, source, field, text, page_lines): each field's own text, and the numbers (from 1) of the lines that are not its own.

    Fields that are null have no row, empty and blank ones keep an empty text; repeated rows give a row
    each. Own lines stay as they stand, in order, blank lines too. Further columns are ignored.
    """
    marks = scored_lines(articles, fields, key, lines_from).groupBy("key", "field", "text_hash", "line_no").agg(F.max("own").alias("own"))
    marks = marks.groupBy("key", "field", "text_hash").agg(F.array_sort(F.collect_list(F.when(~F.col("own"), F.col("line_no")))).alias("page_lines"))
    rows = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields])
    each = articles.select(F.col(key).alias("key"), "source", F.explode(rows).alias("r")).select("key", "source", "r.field", "r.text").where("text is not null").withColumn("text_hash", F.xxhash64("text"))
    m = marks.withColumnsRenamed({"key": "k", "field": "f", "text_hash": "h"})
    joined = each.join(m, each["key"].eqNullSafe(m["k"]) & (each["field"] == m["f"]) & (each["text_hash"] == m["h"]), "left")
    kept = F.filter(F.transform(F.split("text", "\n"), lambda x, i: F.struct(x.alias("line"), (i + 1).alias("no"))), lambda x: ~F.array_contains("page_lines", x["no"]))
    text = F.when(F.size("page_lines") > 0, F.array_join(F.transform(kept, lambda x: x["line"]), "\n")).otherwise(F.col("text"))
    return joined.select(F.col("key").alias(key), "source", "field", text.alias("text"), F.coalesce("page_lines", F.array().cast("array<int>")).alias("page_lines"))


__all__ = ["clean_line", "main_content", "own_lines", "page_templates", "points", "scored_lines"]
