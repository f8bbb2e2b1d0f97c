"""Links of web pages: extraction, filters, file names, first-writer-wins downloads."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import text as T

#: Names that say nothing, words and names that are never fetched.
GENERIC = ("pdf", "doc", "docx", "下載", "點我下載", "檔案", "附件", "download", "file", "開啟檔案")
PARTIAL_BLACKLIST = ("測試用檔案", "無效文件")
EXACT_BLACKLIST = ("LaTex套件下載", "圖書館表單下載", "共授課程期末學生學習心得回饋", "共時授課教學計畫書", "檔案下載", "領域專長模組課程計畫書", "國立中央大學大學部英文畢業門檻審核申請表")


def anchors(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """key, url, ord, href, txt, tr_text of every link in page order, with the text of the row that holds it."""
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from .html_links import links_of

        for frame in frames:
            rows = [(k, u, i, *link) for k, u, h in frame.itertuples(index=False) for i, link in enumerate(links_of(h or ""))]
            yield pd.DataFrame(rows, columns=[key, url, "ord", "href", "txt", "tr_text"])

    return pages.select(key, url, html).mapInPandas(run, f"{key} {kinds[key]}, {url} {kinds[url]}, ord int, href string, txt string, tr_text string")


def wanted(href: Column) -> Column:
    """Whether a link leads to a file: not a script, an anchor or an .odt, and named like a download."""
    h, low = F.coalesce(href, F.lit("")), F.lower(F.coalesce(href, F.lit("")))
    out = (h != "") & ~h.contains("javascript") & (h != "#") & ~low.contains(".odt")
    return out & (low.contains("download") | low.contains("file") | low.contains(".pdf") | low.contains(".doc"))


@F.pandas_udf(StringType())
def resolve(base: pd.Series, href: pd.Series) -> pd.Series:
    """Absolute urls; null where the url cannot be read."""
    from urllib.parse import urljoin

    def one(b, h):
        try:
            return urljoin(b or "", h or "")
        except ValueError:
            return None

    return pd.Series([one(b, h) for b, h in zip(base, href)], dtype=object)


def link_name(txt: Column, tr_text: Column) -> Column:
    """The name a link's text gives; where that says nothing, the first line of its table row, if longer than 3."""
    name = T.safe_name(T.first_line(F.coalesce(txt, F.lit(""))))
    row = T.safe_name(T.first_line(F.coalesce(tr_text, F.lit(""))))
    bare = F.lower(T.strip(T.without_number(name)))
    poor = says_nothing(name, 3) | bare.isin(*GENERIC)
    return F.when(poor & (F.length(row) > 3), row).otherwise(name)


def blacklisted(name: Column) -> Column:
    out = name.isin(*EXACT_BLACKLIST)
    for word in PARTIAL_BLACKLIST:
        out = out | name.contains(word)
    return out


def extension(href: Column, name: Column) -> Column:
    has = lambda s: F.lower(href).contains(s) | F.lower(name).contains(s)
    return F.when(has(".docx"), ".docx").when(has(".doc"), ".doc").otherwise(".pdf")


def candidates(links: DataFrame, url: str = "url") -> DataFrame:
    """links worth fetching, with full_url, name and ext."""
    named = links.where(wanted(F.col("href"))).withColumn("name", link_name(F.col("txt"), F.col("tr_text"))).where(~blacklisted(F.col("name")))
    named = named.withColumns({"ext": extension(F.col("href"), F.col("name")), "full_url": resolve(F.col(url), F.col("href"))})
    return named.withColumn("name", T.without_extension("name"))


def without_existing(files: DataFrame, existing: DataFrame, name: Column) -> DataFrame:
    """files whose name is not in existing(file_name); names that say nothing are not looked up."""
    keyed = files.withColumn("__file_name", name)
    return keyed.join(existing.select(F.col("file_name").alias("__file_name")).distinct(), "__file_name", "left_anti").drop("__file_name")


def page_title(first_page: Column) -> Column:
    """A title from a document's first page: its first line, at most 50 characters, if more than 2 are left."""
    line = T.safe_name(F.left(F.coalesce(T.first_line(first_page), F.lit("")), F.lit(50)))
    return F.when(F.length(line) > 2, line)


def downloads(links: DataFrame, existing: DataFrame, fetch: Callable[[DataFrame], DataFrame], order: list[str], title: Column | None = None) -> DataFrame:
    """file_name, full_url, content of the files to store.

    fetch adds status and content. Only status 200 counts, and only a fetched file claims its name; the first in `order`
    wins. title gives a name to .pdf files whose own says nothing; files still without one are left out.
    """
    known = says_nothing(F.col("name"))
    named = without_existing(candidates(links), existing, F.when(~known, F.concat("name", "ext")))
    got = fetch(named).where("status = 200")
    poor = (F.col("ext") == ".pdf") & says_nothing(F.col("name"), 3)
    got = got.withColumn("name", F.when(poor, F.coalesce(title if title is not None else F.lit(None).cast("string"), F.col("name"))).otherwise(F.col("name"))).where(~known)
    got = without_existing(got.withColumn("file_name", F.concat("name", "ext")), existing, F.col("file_name"))
    return first_writer(got, "file_name", order)


def first_writer(files: DataFrame, name: str, order: list[str]) -> DataFrame:
    """One row for each name: the first in `order`."""
    w = Window.partitionBy(name).orderBy(*order)
    return files.withColumn("__place", F.row_number().over(w)).where("__place = 1").drop("__place")


def store(files: DataFrame, path: str) -> int:
    """Write files(file_name, content) to the table at path and give their number, counted as they are written."""
    seen = Observation("stored")
    files.observe(seen, F.count("*").alias("files")).write.mode("append").parquet(path)
    return seen.get["files"]


def tally(links: DataFrame, files: DataFrame, by: str) -> DataFrame:
    """by, links, files: how many links each page or seed has, and how many of them became files."""
    counted = links.groupBy(by).agg(F.count("*").alias("links"))
    return counted.join(files.groupBy(by).agg(F.count("*").alias("files")), by, "left").withColumn("files", F.coalesce("files", F.lit(0)))


def says_nothing(name: Column, short: int = 0) -> Column:
    """Whether a name is empty, generic in any case, or no longer than `short` characters."""
    return (name == "") | F.lower(name).isin(*GENERIC) | (F.length(name) <= short)
