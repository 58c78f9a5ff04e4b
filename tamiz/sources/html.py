"""Articles, links and structure of HTML pages held in a column.

Pages are parsed in Arrow batches by the standard library's parser into a small
tree that a subset of CSS selectors searches: ``tag``, ``.class``, ``#id``,
``[attr]``, ``[attr=value]``, descendants, ``>`` and commas. Unclosed and stray
tags do no harm; a null or empty page has no articles.
"""

from __future__ import annotations

import html.parser
import re
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import urljoin, urlparse

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements that end an open one of their kind.
_CLOSES = {"li": {"li"}, "p": {"p"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}}


class Node:
    """One element: its tag, attributes, parent, and children (elements and texts)."""

    __slots__ = ("attrs", "children", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []

    def walk(self) -> Iterator[Node]:
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            node = stack.pop()
            yield node
            stack += [c for c in reversed(node.children) if isinstance(c, Node)]

    def text(self, separator: str = " ") -> str:
        """All text below, pieces joined, white space collapsed; scripts and styles left out."""
        pieces: list[str] = []
        stack: list[Node | str] = [self]
        while stack:
            item = stack.pop()
            if isinstance(item, str):
                pieces.append(item)
            elif item.tag not in ("script", "style"):
                stack += reversed(item.children)
        return " ".join(separator.join(p.strip() for p in pieces if p.strip()).split())

    def select(self, selector: str) -> list[Node]:
        """Elements below that fit a selector, in document order."""
        chains = [_parse_chain(part) for part in selector.split(",")]
        return [n for n in self.walk() if any(_fits_chain(n, chain) for chain in chains)]

    def first(self, selector: str) -> Node | None:
        chains = [_parse_chain(part) for part in selector.split(",")]
        return next((n for n in self.walk() if any(_fits_chain(n, chain) for chain in chains)), None)


class _Builder(html.parser.HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.open = Node("", {}, None)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _CLOSES and self.open.tag in _CLOSES[tag]:
            self.open = self.open.parent or self.root
        node = Node(tag, {k: v or "" for k, v in attrs}, self.open)
        self.open.children.append(node)
        if tag not in _VOID:
            self.open = node

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.open.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.open))

    def handle_endtag(self, tag: str) -> None:
        node: Node | None = self.open
        while node is not None and node.tag != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.open = node.parent

    def handle_data(self, data: str) -> None:
        self.open.children.append(data)

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        # The standard parser gives up on a marked section of no known kind; it is a comment up to the next ">".
        try:
            return super().parse_marked_section(i, report)
        except AssertionError:
            return self.parse_bogus_comment(i)


def parse(page: str) -> Node:
    """Tree of one page."""
    builder = _Builder()
    builder.feed(page)
    builder.close()
    return builder.root


_SIMPLE = re.compile(r"([a-zA-Z][\w-]*|\*)?((?:[.#][\w-]+|\[[^\]]*\])*)$")
_PART = re.compile(r"[.#][\w-]+|\[[^\]]*\]")


@lru_cache(1024)
def _parse_chain(text: str) -> list[tuple[str, tuple]]:
    """[(combinator before it, simple selector)], outermost first."""
    chain, combinator = [], " "
    for token in re.findall(r">|(?:\[[^\]]*\]|[^\s>])+", text.strip()):
        if token == ">":
            combinator = ">"
            continue
        found = _SIMPLE.match(token)
        if not found:
            raise ValueError(f"selector not understood: {text!r}")
        tag, parts = found.group(1) or "*", _PART.findall(found.group(2))
        classes = [p[1:] for p in parts if p[0] == "."]
        ids = [p[1:] for p in parts if p[0] == "#"]
        attributes = [tuple(x.strip().strip("\"'") for x in p[1:-1].partition("=")[::2]) if "=" in p else (p[1:-1].strip(), None) for p in parts if p[0] == "["]
        chain.append((combinator, (tag.lower(), tuple(classes), tuple(ids), tuple(attributes))))
        combinator = " "
    return chain


def _fits(node: Node, simple: tuple) -> bool:
    tag, classes, ids, attributes = simple
    if tag != "*" and node.tag != tag:
        return False
    own = node.attrs.get("class", "").split()
    return all(c in own for c in classes) and all(node.attrs.get("id") == i for i in ids) and all(k in node.attrs and (v is None or node.attrs[k] == v) for k, v in attributes)


def _fits_chain(node: Node, chain: list[tuple[str, tuple]]) -> bool:
    if not chain or not _fits(node, chain[-1][1]):
        return False
    if len(chain) == 1:
        return True
    above, direct = chain[:-1], chain[-1][0] == ">"
    parent = node.parent
    while parent is not None:
        if _fits_chain(parent, above):
            return True
        if direct:
            return False
        parent = parent.parent
    return False


#: Pages whose articles leave the parser together (memory only).
CHUNK = 500
#: Where the parts of an article stand.
SELECTORS = {"articulo": "article.noticia", "titulo": "h2", "cuerpo": "p.cuerpo", "fecha": "span.fecha", "autor": "span.autor", "enlace": "a.leer-mas"}


def _target(base: str, href: str | None) -> str:
    """Where a link leads; empty if it has no address or none that can be read."""
    try:
        return urljoin(base, href) if href else ""
    except ValueError:
        return ""


def articles_of(page: str, base: str, selectors: dict[str, str] = SELECTORS) -> tuple[list[dict], list[str]]:
    """(articles, errors) of one page; an article that lacks a part is an error with its number."""
    rows, errors = [], []
    for number, node in enumerate(parse(page).select(selectors["articulo"]), 1):
        row: dict = {"categoria_original": node.attrs.get("data-categoria", "sin_categoria"), "fuente": base}
        lacking = None
        for part in ("titulo", "cuerpo", "fecha", "autor"):
            found = node.first(selectors[part])
            row[part] = found.text() if found else ""
            if not row[part]:
                lacking = lacking or part
        link = node.first(selectors["enlace"])
        row["url"] = _target(base, link.attrs.get("href")) if link else ""
        if not row["url"]:
            lacking = lacking or "url"
        if lacking:
            errors.append(f"Artículo {number}: falta {lacking}")
            continue
        rows.append(row)
    return rows, errors


_ARTICLE = "titulo string, cuerpo string, fecha string, autor string, categoria_original string, url string, fuente string"


def extract_articles(pages: DataFrame, html_column: str, url_column: str, selectors: dict[str, str] = SELECTORS) -> DataFrame:
    """(pagina, orden, titulo, cuerpo, fecha, autor, categoria_original, url, fuente, error): a row an article or error."""
    columns = ["pagina", "orden", "titulo", "cuerpo", "fecha", "autor", "categoria_original", "url", "fuente", "error"]

    def extract(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start in range(0, max(len(frame), 1), CHUNK):
                part, out = frame.iloc[start : start + CHUNK], []
                for page, base in zip(part[html_column], part[url_column], strict=True):
                    rows, errors = articles_of(page or "", base or "", selectors)
                    out += [{**row, "pagina": base, "orden": i} for i, row in enumerate(rows, 1)]
                    out += [{"pagina": base, "error": e} for e in errors]
                # As objects: a column without any value is of floats otherwise, which Arrow does not take for text.
                yield pd.DataFrame([[row.get(c) for c in columns] for row in out], columns=columns, dtype=object)

    return pages.select(html_column, url_column).mapInPandas(extract, f"pagina string, orden int, {_ARTICLE}, error string")


def listing_items(page: str, url: str, item: str, fields: dict[str, str | None] | None = None, min_link_chars: int = 20) -> list[dict]:
    """Items of a listing page: title, summary, link and optional fields by selector, with the usual defaults.

    Items without a title and links seen before on the page are left out. A page
    without items gives its links of ``min_link_chars`` characters or more that
    stay on its site.
    """
    fields, root = fields or {}, parse(page)
    out, seen = [], set()
    for node in root.select(item):
        def text_of(name: str, default: str | None = None, within: Node = node) -> str:
            found = within.first(fields.get(name) or default) if fields.get(name) or default else None
            return found.text() if found else ""

        title = text_of("titulo", "h1, h2, h3")
        link = node.first(fields.get("url") or "a")
        target = urljoin(url, link.attrs["href"]) if link is not None and link.attrs.get("href") else url
        if not title or target in seen:
            continue
        seen.add(target)
        out.append({"titulo": title, "resumen": text_of("resumen", "p"), "url": target, "fecha": text_of("fecha"), "autor": text_of("autor"), "categoria": text_of("categoria")})
    if out:
        return out
    site = urlparse(url).netloc
    for link in root.select("a[href]"):
        title, target = link.text(), urljoin(url, link.attrs["href"])
        parts = urlparse(target)
        if len(title) >= min_link_chars and parts.scheme in ("http", "https") and (parts.netloc == site or parts.netloc.endswith("." + site)) and target not in seen:
            seen.add(target)
            out.append({"titulo": title, "resumen": "", "url": target, "fecha": "", "autor": "", "categoria": ""})
    return out


# Texts of a link to the next page.
NEXT_TEXTS = {"next", "siguiente", "older", "older posts", "mas", "más", ">", "›", "»"}


def next_page(page: str, url: str, selector: str = "a.siguiente") -> str | None:
    """The link to the next page: by selector, or by its relation, text or label."""
    root = parse(page)
    found = root.first(selector)
    if found is None or not found.attrs.get("href"):

        def leads_on(a: Node) -> bool:
            label = a.attrs.get("aria-label", "").casefold()
            return "next" in a.attrs.get("rel", "").casefold() or a.text().casefold() in NEXT_TEXTS or "next" in label or "siguiente" in label

        found = next((a for a in root.select("a[href]") if leads_on(a)), None)
    return urljoin(url, found.attrs["href"]) if found is not None and found.attrs.get("href") else None


def crawl_listing(pages: DataFrame, start: str, item: str, max_pages: int = 5, minimum: int = 20, url_column: str = "url", html_column: str = "html") -> DataFrame:
    """Items of a chain of listing pages (url, html), from ``start`` along the links to the next page.

    The chain is found first, page by page, by lookups of its at most
    ``max_pages`` URLs in the table of pages; it ends where a page is missing,
    holds no items, leads nowhere or back, or ``minimum`` items are reached. Items
    are unique by URL, the first one wins, and are cut at ``minimum``.
    """
    rows: list[tuple] = []
    seen: set[str] = set()
    visited: set[str] = set()
    url: str | None = start
    while url and url not in visited and len(visited) < max_pages and len(rows) < minimum:
        visited.add(url)
        found = pages.where(F.col(url_column) == url).select(html_column).limit(1).collect()
        if not found or not found[0][0]:
            break
        items = [x for x in listing_items(found[0][0], url, item) if x["url"] not in seen]
        if not items:
            break
        seen |= {x["url"] for x in items}
        rows += [(len(rows) + i, url, x["titulo"], x["resumen"], x["url"], x["fecha"], x["autor"], x["categoria"]) for i, x in enumerate(items)]
        url = next_page(found[0][0], url)
    return pages.sparkSession.createDataFrame(rows[:minimum], "pos long, pagina_origen string, titulo string, resumen string, url string, fecha string, autor string, categoria string")


def listing_table(pages: DataFrame, item: str, fields: dict[str, str | None] | None = None, url_column: str = "url", html_column: str = "html") -> DataFrame:
    """(pagina, orden, titulo, resumen, url, fecha, autor, categoria) of every listing page (url, html), each read once.

    Links seen before on the page are left out; over pages see :func:`first_listed`.
    """
    names = ["pagina", "orden", "titulo", "resumen", "url", "fecha", "autor", "categoria"]

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [
                (url, i, *(x[n] for n in names[2:]))
                for url, page in zip(frame[url_column], frame[html_column], strict=True)
                for i, x in enumerate(listing_items(page or "", url or "", item, fields), 1)
            ]
            yield pd.DataFrame(rows, columns=names)

    return pages.select(url_column, html_column).mapInPandas(read, "pagina string, orden int, titulo string, resumen string, url string, fecha string, autor string, categoria string")


def first_listed(items: DataFrame, pages: DataFrame, order: str, url_column: str = "url") -> DataFrame:
    """The items of :func:`listing_table` whose URL no page before lists, pages taken by their column ``order``."""
    placed = items.join(pages.select(F.col(url_column).alias("pagina"), F.col(order).alias("_page")), "pagina")
    least = placed.groupBy("url").agg(F.min(F.struct("_page", "orden")).alias("_first"))
    return placed.join(least, "url").where(F.struct("_page", "orden") == F.col("_first")).select(*items.columns)


def listing_diagnostics(pages: DataFrame, item: str, url_column: str = "url", html_column: str = "html") -> DataFrame:
    """(pagina, elementos, sin_titulo, repetidos, articulos, siguiente) of every listing page: what was found, what was left out, where it leads."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for url, page in zip(frame[url_column], frame[html_column], strict=True):
                nodes = parse(page or "").select(item)
                found = listing_items(page or "", url or "", item)
                blank = sum(1 for n in nodes if not ((h := n.first("h1, h2, h3")) and h.text()))
                rows.append((url, len(nodes), blank, len(nodes) - blank - len(found) if nodes else 0, len(found), next_page(page or "", url or "")))
            yield pd.DataFrame(rows, columns=["pagina", "elementos", "sin_titulo", "repetidos", "articulos", "siguiente"])

    return pages.select(url_column, html_column).mapInPandas(read, "pagina string, elementos int, sin_titulo int, repetidos int, articulos int, siguiente string")


def dom_profile(pages: DataFrame, html_column: str, ident: str) -> DataFrame:
    """(ident, titulo, navegacion, articulos, articulos_main, tendencias, pie) of each page."""

    def profile(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for key, page in zip(frame[ident], frame[html_column], strict=True):
                root = parse(page or "")
                title, footer = root.first("title"), root.first("footer")
                out.append((key, title.text() if title else "Sin título", [a.text() for a in root.select("nav a")], len(root.select("article")), len(root.select("main article")), [a.text() for a in root.select("aside li a")], footer.text() if footer else "Sin footer"))
            yield pd.DataFrame(out, columns=[ident, "titulo", "navegacion", "articulos", "articulos_main", "tendencias", "pie"])

    kind = pages.schema[ident].dataType.simpleString()
    return pages.select(ident, html_column).mapInPandas(profile, f"{ident} {kind}, titulo string, navegacion array<string>, articulos int, articulos_main int, tendencias array<string>, pie string")
