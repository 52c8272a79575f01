"""Extraction from catalogue HTML, in Arrow batches with the standard parser."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aspectra.functions.text import price_from_text

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class Node:
    """An element: tag, attributes, children (elements and texts)."""

    def __init__(self, tag: str, attributes: dict[str, str], parent: Node | None):
        self.tag, self.attributes, self.parent = tag, attributes, parent
        self.children: list[Node | str] = []

    def walk(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def find_all(self, tag: str, css: str | None = None) -> Iterator[Node]:
        for node in self.walk():
            if node is not self and node.tag == tag and (css is None or css in node.attributes.get("class", "").split()):
                yield node

    def find(self, tag: str, css: str | None = None) -> Node | None:
        return next(self.find_all(tag, css), None)

    def text(self, separator: str = "") -> str:
        """All text inside; with strip-and-join semantics when a piece is blank it is left out."""
        found: list[str] = []
        stack: list[Node | str] = [self]
        while stack:
            item = stack.pop()
            if isinstance(item, str):
                found.append(item)
            elif item.tag not in ("script", "style"):
                stack.extend(reversed(item.children))
        return separator.join(found)

    def stripped(self) -> str:
        return "".join(t for t in (p.strip() for p in self.text("\0").split("\0")) if t)


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag: str) -> None:
        node: Node | None = self.at
        while node is not None and node.tag != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.at = node.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def parse(html: str | None) -> Node:
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root


def product_items(html: str | None) -> list[dict]:
    """Name, URL, price text and image of each listed product that has a name."""
    out = []
    for item in parse(html).find_all("div", "product-list-item"):
        holder = item.find("p", "name")
        anchor = holder.find("a") if holder else None
        if anchor is None:
            continue
        price, image = item.find("p", "price"), item.find("img", "lazy")
        out.append(
            {
                "product_name": anchor.stripped(),
                "url": anchor.attributes.get("href", ""),
                "price_str": price.stripped() if price else "",
                "image": image.attributes.get("data-original", "") if image else "",
            }
        )
    return out


def spec_table(html: str | None) -> dict[str, str]:
    """Rows of two cells of the first specification table; of repeated keys the last counts."""
    box = parse(html).find("div", "product-lightbox-content")
    table = box.find("table") if box else None
    out: dict[str, str] = {}
    for row in table.find_all("tr") if table else ():
        cells = list(row.find_all("td"))
        if len(cells) == 2:
            out[cells[0].text().strip().replace(":", "")] = cells[1].text().strip()
    return out


def anchors(html: str | None) -> list[dict]:
    return [{"href": a.attributes["href"], "label": a.stripped()} for a in parse(html).find_all("a") if "href" in a.attributes]


def _exploded(pages: DataFrame, key: str, html: str, extract: Callable[[str | None], list[dict]], fields: list[str]) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, i, *[item[f] for f in fields]) for k, text in zip(batch["key"], batch["html"], strict=True) for i, item in enumerate(extract(text))]
            yield pd.DataFrame(rows, columns=[key, "place", *fields])

    schema = f"{key} long, place int, " + ", ".join(f"{f} string" for f in fields)
    return pages.select(F.col(key).alias("key"), F.col(html).alias("html")).mapInPandas(run, schema)


def catalogue_links(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, place, product_name, url, price_vnd, price_str, image) of all listed products."""
    found = _exploded(pages, key, html, product_items, ["product_name", "url", "price_str", "image"])
    return found.withColumn("price_vnd", price_from_text(F.col("price_str")))


def page_anchors(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, place, href, label) of all anchors with a target."""
    return _exploded(pages, key, html, anchors, ["href", "label"])


def spec_maps(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, specs): the specification table as map<label, value>; empty where there is none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({key: batch["key"], "specs": [spec_table(t) for t in batch["html"]]})

    return pages.select(F.col(key).alias("key"), F.col(html).alias("html")).mapInPandas(run, f"{key} long, specs map<string,string>")
