"""Parsers of fetched payloads: search results, sitemaps, feeds, links, robots files."""

from __future__ import annotations

import xml.etree.ElementTree as ElementTree
from collections.abc import Iterator
from urllib.parse import urljoin, urlsplit
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.pages import by_page, parse


def parse_google(payloads: DataFrame) -> DataFrame:
    j = F.from_json("payload", "struct<items:array<struct<link:string,title:string,snippet:string>>>")
    return payloads.select("query", F.posexplode(j["items"]).alias("rank", "r")).select("query", "rank", F.coalesce("r.link", F.lit("")).alias("url"), F.coalesce("r.title", F.lit("")).alias("title"), F.coalesce("r.snippet", F.lit("")).alias("description"))


def parse_bing(payloads: DataFrame) -> DataFrame:
    j = F.from_json("payload", "struct<webPages:struct<value:array<struct<url:string,name:string,snippet:string>>>>")
    return payloads.select("query", F.posexplode(j["webPages"]["value"]).alias("rank", "r")).select("query", "rank", F.coalesce("r.url", F.lit("")).alias("url"), F.coalesce("r.name", F.lit("")).alias("title"), F.coalesce("r.snippet", F.lit("")).alias("description"))


def parse_ddg(payloads: DataFrame, limit: int = 10) -> DataFrame:
    """The abstract first, if it has a url, then the related topics."""
    j = F.from_json("payload", "struct<Abstract:string,AbstractURL:string,Heading:string,RelatedTopics:array<struct<FirstURL:string,Text:string>>>")
    rows = payloads.select("query", j.alias("j"))
    said = (F.coalesce("j.Abstract", F.lit("")) != "") & (F.coalesce("j.AbstractURL", F.lit("")) != "")
    head = F.when(said, F.array(F.struct(F.col("j.AbstractURL").alias("url"), F.coalesce("j.Heading", "query").alias("title"), F.col("j.Abstract").alias("description")))).otherwise(F.array())
    topics = F.filter(F.coalesce("j.RelatedTopics", F.array()), lambda t: F.coalesce(t["FirstURL"], F.lit("")) != "")
    tail = F.transform(topics, lambda t: F.struct(t["FirstURL"].alias("url"), F.split_part(F.coalesce(t["Text"], F.lit("")), F.lit(" - "), F.lit(1)).alias("title"), F.coalesce(t["Text"], F.lit("")).alias("description")))
    return rows.select("query", F.posexplode(F.slice(F.concat(head, tail), 1, limit)).alias("rank", "r")).select("query", "rank", "r.*")


#: Adapters of search engines by name.
ADAPTERS = {"google": parse_google, "bing": parse_bing, "duckduckgo": parse_ddg}


def parse_search(payloads: DataFrame, engine: str) -> DataFrame:
    if engine not in ADAPTERS:
        raise ValueError(f"no adapter for {engine}")
    return ADAPTERS[engine](payloads.where(F.col("engine") == engine)).withColumn("source_engine", F.lit(engine))


def _xml_urls(pick) -> object:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for source, text in zip(batch["source_id"], batch["xml"]):
                try:
                    found = pick(ElementTree.fromstring(text))
                except (ElementTree.ParseError, TypeError):
                    found = []
                rows += [(source, k, u) for k, u in enumerate(found)]
            yield pd.DataFrame(rows, columns=["source_id", "seq", "url"])

    return run


def _name(element) -> str:
    return element.tag.rpartition("}")[2]


def _locations(root) -> list[str]:
    return [c.text.strip() for u in root.iter() if _name(u) == "url" for c in u if _name(c) == "loc" and (c.text or "").strip()]


def _entries(root) -> list[str]:
    out = []
    for e in root.iter():
        if _name(e) == "item":
            out += [c.text.strip() for c in e if _name(c) == "link" and (c.text or "").strip()]
        elif _name(e) == "entry":
            out += [c.get("href") for c in e if _name(c) == "link" and c.get("href") and c.get("rel", "alternate") == "alternate"]
    return out


def parse_sitemaps(documents: DataFrame) -> DataFrame:
    """(source_id, seq, url) of ``url/loc``; nothing for an index or bad XML."""
    return documents.select("source_id", "xml").mapInPandas(_xml_urls(_locations), "source_id string, seq int, url string")


def parse_feeds(documents: DataFrame) -> DataFrame:
    """(source_id, seq, url) of RSS items and Atom entries."""
    return documents.select("source_id", "xml").mapInPandas(_xml_urls(_entries), "source_id string, seq int, url string")


def page_links(pages: DataFrame) -> DataFrame:
    """(page_id, seq, url, domain, base_domain, anchor) of every link, resolved."""

    def read(page_id: int, base: str, html: str) -> list[tuple]:
        host, rows = urlsplit(base).netloc.lower(), []
        for k, a in enumerate(parse(html or "").find_all("a")):
            if a.attributes.get("href") is not None:
                try:
                    url = urljoin(base, a.attributes["href"])
                    rows.append((page_id, k, url, urlsplit(url).netloc.lower(), host, a.text().strip()[:100]))
                except ValueError:
                    continue
        return rows

    schema = "page_id long, seq int, url string, domain string, base_domain string, anchor string"
    return pages.select("page_id", "url", "html").mapInArrow(by_page(read, schema), schema)


def internal_links(links: DataFrame, max_urls: int) -> DataFrame:
    from quarry.operators.filters import top_per_group

    same = links.where("domain = base_domain").groupBy("page_id", "url").agg(F.min("seq").alias("seq"))
    return top_per_group(same, ["page_id"], [F.asc("seq")], max_urls)


def external_links(links: DataFrame, first: int = 20) -> DataFrame:
    from quarry.operators.filters import top_per_group

    other = links.where((F.col("domain") != F.col("base_domain")) & (F.col("domain") != "") & ~F.startswith("domain", F.lit("www.")))
    return top_per_group(other, ["page_id"], [F.asc("seq")], first)


def robots_allowed(urls: DataFrame, robots: DataFrame, agent: str = "*") -> DataFrame:
    """Urls that the robots file of their domain allows; a missing file allows all. urls: url, domain."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parsed: dict[str, RobotFileParser] = {}
        for batch in batches:
            keep = []
            for url, text in zip(batch["url"], batch["robots_txt"]):
                if not isinstance(text, str):
                    keep.append(True)
                    continue
                if text not in parsed:
                    if len(parsed) > 10_000:
                        parsed.clear()
                    parsed[text] = RobotFileParser()
                    parsed[text].parse(text.splitlines())
                keep.append(parsed[text].can_fetch(agent, url))
            yield batch[keep][["url", "domain"]]

    return urls.select("url", "domain").join(robots.select("domain", "robots_txt"), "domain", "left").select("url", "domain", "robots_txt").mapInPandas(run, "url string, domain string")


def export_table(df: DataFrame, path: str, kind: str = "json", since: str | None = None, until: str | None = None, time: str = "crawled_at", drop: list[str] | None = None) -> None:
    """Write a table as JSON lines or CSV, the rows whose ``time`` lies from ``since`` on and before ``until`` where these are given;
    arrays become JSON text in CSV. The filter reaches the scan."""
    if kind not in ("json", "csv"):
        raise ValueError("json or csv")
    if since is not None:
        df = df.where(F.col(time) >= F.lit(since).cast("timestamp_ntz"))
    if until is not None:
        df = df.where(F.col(time) < F.lit(until).cast("timestamp_ntz"))
    df = df.drop(*(drop or []))
    if kind == "csv":
        nested = [f.name for f in df.schema if f.dataType.typeName() in ("array", "map", "struct")]
        df = df.withColumns({c: F.to_json(c) for c in nested})
    getattr(df.write.mode("overwrite"), kind)(path, **({"header": True} if kind == "csv" else {}))
