"""Tables with row and column spans, timetables in long and in grid form, and the table density gate."""

from __future__ import annotations

import ast
import json
from collections.abc import Iterable, Iterator
from itertools import count, groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import text as T

#: The periods with their times, those that are left out when empty, and the days.
PERIODS = (("第一節", "08:00-08:50"), ("第二節", "09:00-09:50"), ("第三節", "10:00-10:50"), ("第四節", "11:00-11:50"), ("中午", "12:00-12:50"), ("第五節", "13:00-13:50"), ("第六節", "14:00-14:50"), ("第七節", "15:00-15:50"), ("第八節", "16:00-16:50"), ("第九節", "17:00-17:50"), ("第Ａ節", "18:00-18:50"), ("第Ｂ節", "19:00-19:50"), ("第Ｃ節", "20:00-20:50"))
OPTIONAL = ("中午", "第九節", "第Ａ節", "第Ｂ節", "第Ｃ節")
DAYS = ("星期一", "星期二", "星期三", "星期四", "星期五", "星期六")
#: Orders are cut into so many slices.
SLICES = 4096
_WIDE = (("第A節", "第Ａ節"), ("第B節", "第Ｂ節"), ("第C節", "第Ｃ節"))


#: Rows are put out when they hold so many characters, each row counted as 100 besides.
_AT_ONCE = 4 << 20


def in_batches(rows: Iterable[tuple], schema: pa.Schema, most: int = _AT_ONCE) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of about `most` characters, so that a task holds no more however many rows its input gives."""
    held, size = [], 0
    made = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
    for row in rows:
        held.append(row)
        size += 100 + sum([len(x) for x in row if isinstance(x, str)])
        if size > most:
            yield made()
            held, size = [], 0
    if held:
        yield made()


def html_cells(pages: DataFrame, key: str = "page_id", html: str = "html", table_id: str | None = None) -> DataFrame:
    """key, r, ord, rowspan, colspan, text of every table cell."""
    kind = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .html_links import cells_of

        for batch in batches:
            schema = pa.schema([(key, batch.column(0).type), *((c, pa.int32()) for c in ("r", "ord", "rowspan", "colspan")), ("text", pa.string())])
            yield from in_batches(((k.as_py(), *c) for k, h in zip(*batch.columns) for c in cells_of(h.as_py() or "", table_id)), schema)

    return pages.select(key, html).mapInArrow(run, f"{key} {kind}, r int, ord int, rowspan int, colspan int, text string")


def spread(cells: list[tuple]) -> dict[tuple[int, int], str]:
    """The dense grid of (r, ord, rowspan, colspan, text) cells of one table.

    A column is taken as long as a span from above reaches into the row. A cell starts at the first free column after its
    row's earlier cells; where it is wide it covers whatever is there.
    """
    grid: dict[tuple[int, int], str] = {}
    free_from: dict[int, int] = {}  # the first row in which each column is free again
    for r, row in groupby(sorted(cells, key=lambda c: c[:2]), key=lambda c: c[0]):
        at = 0
        for _, _, down, across, text in row:
            at = next(c for c in count(at) if free_from.get(c, 0) <= r)
            for c in range(at, at + across):
                free_from[c] = max(free_from.get(c, 0), r + down)
                grid.update(((i, c), text) for i in range(r, r + down))
            at += max(across, 0)
    return grid


def expand_spans(cells: DataFrame, key: str = "table_id") -> DataFrame:
    """key, row, col, text: the dense grid of each table, every covered place with its cell's text.

    A row of a table without spans over rows is placed by the running sum of its widths. Tables with such spans, where
    rows depend on what is above, are laid out one after the other in tasks that hold one table at a time.
    """
    kind = cells.schema[key].dataType.simpleString()
    cells = cells.select(key, "r", "ord", "rowspan", F.greatest("colspan", F.lit(0)).alias("colspan"), "text")
    tall = cells.where("rowspan > 1").select(F.col(key).alias("__tall")).distinct()
    is_tall = cells[key].eqNullSafe(F.col("__tall"))
    w = Window.partitionBy(key, "r").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ended = cells.join(tall, is_tall, "left_anti").withColumn("__end", F.sum("colspan").over(w)).where("colspan > 0 AND rowspan > 0")
    flat = ended.select(key, F.col("r").cast("int").alias("row"), F.explode(F.sequence((F.col("__end") - F.col("colspan")).cast("int"), (F.col("__end") - 1).cast("int"))).alias("col"), "text")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = ((k, tuple(c)) for frame in frames for k, *c in frame.itertuples(index=False, name=None))
        out: list[tuple] = []
        for k, table in groupby(rows, key=lambda x: x[0]):
            out += [(k, r, c, t) for (r, c), t in spread([c for _, c in table]).items()]
            if len(out) > 50_000:
                yield pd.DataFrame(out, columns=[key, "row", "col", "text"])
                out = []
        yield pd.DataFrame(out, columns=[key, "row", "col", "text"])

    together = cells.join(tall, is_tall, "left_semi").repartition(key).sortWithinPartitions(key, "r", "ord")
    return flat.unionByName(together.mapInPandas(run, f"{key} {kind}, row int, col int, text string"))


def unpivot(grid: DataFrame, key: str = "table_id") -> DataFrame:
    """key, day, period, time, raw_content, details of every filled cell of a timetable grid (row 0 is its header)."""
    cell = lambda c: F.max(F.when(F.col("col") == c, F.col("text")))
    wide = grid.groupBy(key, "row").agg(F.max("col").alias("last"), cell(1).alias("period"), cell(2).alias("time"))
    head = grid.where("row = 0").select(key, "col", F.col("text").alias("head"))
    rows = wide.where((F.col("row") > 0) & (F.col("last") >= 2)).select(key, "row", T.strip(F.coalesce("period", F.lit(""))).alias("period"), T.strip(F.replace(F.coalesce("time", F.lit("")), F.lit("\n"), F.lit(" "))).alias("time")).where("period <> ''")
    body = grid.where("row > 0 AND col >= 3").join(head, [key, "col"]).join(rows, [key, "row"])
    day = F.when(F.coalesce("head", F.lit("")) == "", F.concat(F.lit("未知星期("), F.col("col").cast("string"), F.lit(")"))).otherwise(T.strip("head"))
    return body.where(~T.blank("text")).select(key, "row", "col", day.alias("day"), "period", "time", F.col("text").alias("raw_content"), T.lines("text").alias("details"))


def normal_period(period: Column) -> Column:
    """A period's name with wide letters."""
    out = F.coalesce(period, F.lit(""))
    for a, b in _WIDE:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def accumulate(courses: DataFrame, keys: list[str], order: str, details: str = "details") -> DataFrame:
    """keys, details: the lists of each key one after the other, in order."""
    return courses.groupBy(*keys).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(order, F.coalesce(F.col(details), F.array().cast("array<string>")).alias("d")))), lambda x: x["d"])).alias(details))


def list_chunks(items: DataFrame, key: str, order: str, item: str, size: int = 3) -> DataFrame:
    """key, n, chunk: the items of each key in order of a whole number, `size` at a time.

    Rows are numbered within slices of the order, so that no task gathers or sorts all rows of a key.
    """
    low, high = items.agg(F.min(order), F.max(order)).first()
    width = 1 if low is None else (high - low) // SLICES + 1
    cut = items.select(key, F.col(order).alias("__order"), F.col(item).alias("__item"), F.floor((F.col(order) - F.lit(low or 0)) / width).alias("__slice"))
    earlier = Window.partitionBy(key).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    counted = cut.groupBy(key, "__slice").agg(F.count("*").alias("__n")).select(F.col(key).alias("__key"), F.col("__slice").alias("__of"), F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    placed = cut.withColumn("__at", F.row_number().over(Window.partitionBy(key, "__slice").orderBy("__order", "__item")))
    placed = placed.join(counted, F.col(key).eqNullSafe(F.col("__key")) & F.col("__slice").eqNullSafe(F.col("__of")))
    at = F.col("__before") + F.col("__at") - 1
    held = placed.groupBy(key, F.floor(at / size).alias("n")).agg(F.array_sort(F.collect_list(F.struct(at.alias("at"), "__item"))).alias("__held"))
    return held.select(key, "n", F.transform("__held", lambda x: x["__item"]).alias("chunk"))


def pivot_counts(rows: DataFrame, key: str, column: str, domain: tuple[str, ...]) -> DataFrame:
    """key and, for each value of a fixed domain, how many rows have it; other values are left out."""
    wide = rows.groupBy(key).pivot(column, list(domain)).count()
    return wide.select(key, *(F.coalesce(F.col(f"`{v}`"), F.lit(0)).alias(v) for v in domain))


def timetable(courses: DataFrame, order: str = "ord", key: str | None = None) -> DataFrame:
    """period, time, period_ord and a column of details for each day, for courses(day, period, details, order).

    Rows are the fixed periods; optional ones without any course are left out; other periods and days are not shown.
    With a key there is one such grid for each of its values, and a cell's list holds its courses only.
    """
    by = [key] if key else []
    periods = F.array(*(F.struct(F.lit(i).alias("period_ord"), F.lit(p).alias("period"), F.lit(t).alias("time"), F.lit(p in OPTIONAL).alias("optional")) for i, (p, t) in enumerate(PERIODS)))
    keys = courses.select(*by).distinct() if key else courses.sparkSession.range(1)
    rows = keys.select(*by, F.explode(periods).alias("p")).select(*by, "p.*")
    keyed = courses.withColumns({"period": normal_period(F.col("period")), "day": T.strip(F.coalesce("day", F.lit("")))}).where("period <> '' AND day <> ''")
    held = accumulate(keyed.where(F.col("day").isin(*DAYS)), [*by, "period", "day"], order)
    wide = held.groupBy(*by, "period").pivot("day", list(DAYS)).agg(F.first("details")).withColumn("__any", F.lit(True))
    rows = rows.join(wide, [*by, "period"], "left").where("__any OR NOT optional")
    return rows.select(*by, "period", "time", "period_ord", *(F.coalesce(F.col(f"`{d}`"), F.array().cast("array<string>")).alias(d) for d in DAYS))


def course_cell(details: Column) -> Column:
    """The HTML of one cell: courses of code, title and place; of title and place; or of a title. Texts are escaped."""
    div = lambda kind, x: F.concat(F.lit(f"<div class='course-{kind}'>"), T.escape_html(x), F.lit("</div>"))
    at = lambda c, i: F.get(c, i)
    block = lambda c: F.concat(F.lit("<div class='course-block'>"), F.when(F.size(c) == 3, F.concat(div("code", at(c, 0)), div("title", at(c, 1)), div("location", at(c, 2)))).when(F.size(c) == 2, F.concat(div("title", at(c, 0)), div("location", at(c, 1)))).otherwise(div("title", at(c, 0))), F.lit("</div>"))
    return F.array_join(F.transform(T.chunks(details, 3), block), "<div class='course-divider'></div>")


def dense(n: Column, chars: Column) -> Column:
    """Whether a table of n filled cells with so many characters together is one worth reading as a table."""
    return (n >= 4) & (chars / n < 35)


def dense_tables(cells: DataFrame, docs: DataFrame, key: str = "doc_id", table: tuple[str, ...] = ("page", "tbl")) -> DataFrame:
    """docs(key) with has_table: whether any table has 4 or more filled cells of under 35 characters on average.

    A document without rows in `cells` has no table, unless docs.readable is false: then it is taken to have one.
    """
    filled = cells.where(~T.blank("text")).groupBy(key, *table).agg(F.count("*").alias("n"), F.sum(F.length(T.strip("text"))).alias("chars"))
    found = filled.groupBy(key).agg(F.bool_or(dense(F.col("n"), F.col("chars"))).alias("has_table"))
    readable = F.col("readable") if "readable" in docs.columns else F.lit(True)
    return docs.join(found, key, "left").withColumn("has_table", F.when(readable, F.coalesce("has_table", F.lit(False))).otherwise(True))


_COURSES = "array<struct<day:string,period:string,time:string,raw_content:string,details:array<string>>>"


@F.pandas_udf(StringType())
def literal_to_json(said: pd.Series) -> pd.Series:
    """Python literals as JSON; null for what is none."""

    def one(x: str | None) -> str | None:
        try:
            return None if x is None else json.dumps(ast.literal_eval(x), ensure_ascii=False)
        except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
            return None

    return said.map(one)


def parse_list(content: Column) -> Column:
    """Course records of a bracketed list literal, Python's (quotes of both kinds, None, True) or JSON's, in brackets of any
    depth; null where it is not one."""
    said = T.strip(content)
    inner = F.regexp_replace(F.regexp_replace(said, "^\\[(\\s*\\[)+", "["), "(\\]\\s*)+\\]$", "]")
    opened = said.startswith("[[") | said.rlike("^\\[\\s*\\[")
    plain = F.when(said.startswith("[") & said.endswith("]"), F.when(opened, inner).otherwise(said))
    read = F.from_json(plain, _COURSES)
    # Only what is no JSON is sent to Python: the rest is null there.
    return F.coalesce(read, F.from_json(literal_to_json(F.when(read.isNull(), plain)), _COURSES))


def read_reply(content: Column) -> Column:
    """(kind, text, courses) of a reply: `courses` for a list of course records, Python's or JSON's, inside lists of any
    depth; `nothing` for a null, a blank or an empty list; `text` for all else, with the text as it came.

    The list is read once as a VARIANT. While its first element is a list, that is taken in its place. Records may have
    further fields, lack some, or hold numbers for texts; an element that is no record makes the reply a text.
    """
    said = T.strip(content)
    listed = F.when(said.startswith("[") & said.endswith("]"), said)
    read = F.try_parse_json(listed)
    read = F.coalesce(read, F.try_parse_json(literal_to_json(F.when(read.isNull(), listed))))
    first = lambda v: F.try_variant_get(v, "$[0]", "variant")
    depth = F.length(F.regexp_replace(F.regexp_extract(said, "^[\\[\\s]*", 0), "\\s", ""))
    inner = F.aggregate(F.sequence(F.lit(1), F.greatest(depth, F.lit(1))), read, lambda v, _: F.when(F.schema_of_variant(first(v)).startswith("ARRAY"), first(v)).otherwise(v))

    def tagged(pair: Column) -> Column:
        courses = F.try_variant_get(pair["v"], "$", _COURSES)
        kind = F.when(pair["blank"] | (F.size(courses) == 0), "nothing").when(F.exists(courses, lambda c: c.isNotNull()) & F.forall(courses, lambda c: c.isNotNull()), "courses").otherwise("text")
        return F.struct(kind.alias("kind"), F.when(kind == "text", pair["content"]).alias("text"), F.when(kind == "courses", courses).alias("courses"))

    given = F.struct(inner.alias("v"), T.blank(content).alias("blank"), content.alias("content"))
    return F.get(F.transform(F.array(given), tagged), F.lit(0))
