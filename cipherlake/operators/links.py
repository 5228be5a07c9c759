"""Capture links in tables of fetched pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cipherlake.operators.ranking import dense_numbers, sums_before
from cipherlake.plans.scratch import materialize, small

# Endings of capture files.
CAPTURE_ENDS = (
    ".pcap",
    ".pcapng",
    ".cap",
    ".pcap.gz",
    ".pcap.bz2",
    ".pcap.xz",
    ".pcap.zst",
    ".pcapng.gz",
    ".pcapng.bz2",
    ".pcapng.xz",
    ".pcapng.zst",
    ".cap.gz",
    ".cap.bz2",
    ".cap.xz",
    ".cap.zst",
    ".pcap.zip",
    ".pcapng.zip",
    ".cap.zip",
    ".pcap.tar.gz",
    ".pcapng.tar.gz",
    ".cap.tar.gz",
)


def absolute(page: Column, href: Column) -> Column:
    """A link's address: absolute, from the host's root, or from the page's folder."""
    origin = F.regexp_extract(page, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+)", 1)
    scheme = F.regexp_extract(page, r"^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1)
    path = F.regexp_replace(F.regexp_replace(page, r"[?#].*$", ""), r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]+", "")
    folder = F.regexp_replace(path, r"[^/]*$", "")
    folder = F.when(folder == "", "/").otherwise(folder)
    return F.when(href.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), href).when(href.startswith("//"), F.concat(scheme, href)).when(href.startswith("/"), F.concat(origin, href)).otherwise(F.concat(origin, folder, href))


def page_links(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``key, page_url, pos, href, link`` of every anchor with its place in the page, without links to the parent folder or within the page."""
    hrefs = F.regexp_extract_all(html, F.lit(r"""<a\s[^>]*?href="([^"]*)\""""), 1)
    out = pages.select(key, F.col(url).alias("page_url"), F.posexplode(hrefs).alias("pos", "href")).where(~F.col("href").isin("", "../", "./") & ~F.col("href").startswith("#"))
    return out.withColumn("link", absolute(F.col("page_url"), F.col("href")))


def is_within(link: Column, base: str) -> Column:
    """Whether an address is on the host and under the path of ``base``."""
    return link.startswith(base)


def relative_path(link: Column, base: str) -> Column:
    """Path under ``base``, decoded, without query."""
    rest = F.substr(link, F.lit(len(base) + 1))
    return F.ltrim(F.url_decode(F.replace(F.regexp_replace(rest, r"[?#].*$", ""), F.lit("+"), F.lit("%2B"))), F.lit("/"))


def is_capture(link: Column) -> Column:
    """Whether an address names a capture file."""
    name = F.lower(F.regexp_replace(F.regexp_replace(link, r"[?#].*$", ""), r"^.*/", ""))
    ends = [name.endswith(e) for e in CAPTURE_ENDS]
    out = ends[0]
    for e in ends[1:]:
        out = out | e
    return out


def in_scope(links: DataFrame, base: str, include: str | None = None, exclude: str | None = None) -> DataFrame:
    """Links under ``base``, with their relative path; folders are filtered by their first segment."""
    out = links.where(is_within(F.col("link"), base)).withColumn("rel_path", relative_path(F.col("link"), base))
    top, folder = F.split("rel_path", "/")[0], F.col("link").endswith("/")
    for pattern, wanted in ((include, True), (exclude, False)):
        if pattern:
            hit = top.rlike(pattern)
            out = out.where(~folder | (top == "") | (hit if wanted else ~hit))
    return out


def capture_links(links: DataFrame, base: str) -> DataFrame:
    """``link, rel_path`` of the capture files under ``base``, each once."""
    return in_scope(links, base).where(is_capture(F.col("link"))).groupBy("link").agg(F.min("rel_path").alias("rel_path"))


def reachable(links: DataFrame, start: DataFrame) -> DataFrame:
    """``url, depth`` of the pages reached from ``start (url)`` over the table's links, breadth first, until no page is new."""
    edges = materialize(links.select(F.col("page_url").alias("url"), F.col("link").alias("to")).distinct())
    seen = front = materialize(start.select("url").distinct().withColumn("depth", F.lit(0)))
    depth = 0
    while not front.isEmpty():
        depth += 1
        front = materialize(front.join(edges, "url").select(F.col("to").alias("url")).distinct().join(seen, "url", "left_anti").withColumn("depth", F.lit(depth)))
        seen = seen.union(front)
    return seen


def frontier(links: DataFrame, base: str, include: str | None = None, exclude: str | None = None, max_pages: int | None = None) -> DataFrame:
    """``url, depth, place``: the folders that a crawl from ``base`` visits over ``links (page_url, pos, link)``, in its order.

    A crawl keeps a queue: it visits pages by depth, pages of one depth in the
    order of the pages that led there, and links of one page by their ``pos``; a
    page's first mention counts.  It stays under ``base``, takes only folders
    that pass the filters, and ends after ``max_pages`` visits.  A folder that
    isn't in the table is visited and leads nowhere.

    Each depth is one join of the pages just found with the links, and a
    numbering of what is new; pages found are sent to the links while they are
    few.  The number of rounds is the depth of the links, without a bound.
    """
    edges = in_scope(links, base, include, exclude).where(F.col("link").endswith("/"))
    edges = materialize(edges.select(F.col("page_url").alias("url"), "pos", F.col("link").alias("to")))
    spark = links.sparkSession
    seen = front = materialize(spark.createDataFrame([(base, 0, 0)], "url string, depth int, place long"))
    count = depth = 0
    new = 1
    while new and (max_pages is None or count + new < max_pages):
        count, depth = count + new, depth + 1
        led = edges.join(small(front.select("url", "place")), "url").groupBy("to").agg(F.min(F.struct("place", "pos")).alias("by"))
        found = led.select(F.col("to").alias("url"), "by.*").join(seen.select("url"), "url", "left_anti")
        front = dense_numbers(found.select("url", "place", "pos"), ["place", "pos", "url"], "n").select("url", F.lit(depth).alias("depth"), (F.col("n") + count).alias("place"))
        front = materialize(front if max_pages is None else front.where(F.col("place") < max_pages))
        new = front.count()
        seen = seen.union(front)
    return seen if max_pages is None else seen.where(F.col("place") < max_pages)


def crawled_captures(links: DataFrame, visited: DataFrame, base: str) -> DataFrame:
    """``link, rel_path`` of the capture files under ``base`` that the pages ``visited (url)`` link to, each once."""
    return capture_links(links.join(visited.select(F.col("url").alias("page_url")), "page_url", "left_semi"), base)


def dated_datasets(pages: DataFrame, base: str, text: str = "text", since: str | None = None, limit: int | None = None) -> DataFrame:
    """``date, url`` of dated data set addresses in texts, oldest first, each once."""
    # A line may hold other addresses before the one that counts.
    address = rf"\Q{base.rstrip('/')}\E[^\s\"<]*"
    found = pages.select(F.explode(F.regexp_extract_all(text, F.lit(rf"(\d{{4}}-\d{{2}}-\d{{2}}[^\n]*?{address})"), 1)).alias("m"))
    rows = found.select(F.substring("m", 1, 10).alias("date"), F.concat(F.rtrim(F.regexp_extract("m", rf"({address})$", 1), F.lit("/")), F.lit("/")).alias("url"))
    rows = rows.where(F.col("url").startswith(base)).groupBy("url").agg(F.min("date").alias("date"))
    rows = rows.where(F.col("date") >= since) if since else rows
    rows = rows.orderBy("date", "url")
    return (rows.limit(limit) if limit else rows).select("date", "url")


def byte_budget(files: DataFrame, size: str, order: str, budget: int) -> DataFrame:
    """Files in a unique order until their bytes reach the budget; the one that crosses it is kept.

    Adds ``bytes_before``, summed by ranges of the order.
    """
    return sums_before(files, order, {"bytes_before": size}).where(F.col("bytes_before") < budget)


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def manifest_match(captures: DataFrame, manifest: DataFrame, path: str = "path") -> DataFrame:
    """Captures with the ``url`` and ``rel_path`` of their manifest row: the first in order of ``row`` with the same full path or base name."""
    m = manifest.select(F.col("url"), F.col("rel_path"), F.col("local_path"), F.col("row"))
    names = m.select("url", "rel_path", "row", F.explode(F.array_distinct(F.array(F.concat(F.lit("p:"), "local_path"), F.concat(F.lit("n:"), base_name(F.col("local_path"))), F.concat(F.lit("n:"), base_name(F.col("rel_path")))))).alias("k"))
    best = names.groupBy("k").agg(F.min(F.struct("row", "url", "rel_path")).alias("m"))
    keyed = captures.select("*", F.explode(F.array(F.concat(F.lit("p:"), F.col(path)), F.concat(F.lit("n:"), base_name(F.col(path))))).alias("k"))
    joined = keyed.join(best, "k", "left")
    return joined.groupBy(*captures.columns).agg(F.min("m").alias("m")).select(*captures.columns, "m.url", "m.rel_path")
