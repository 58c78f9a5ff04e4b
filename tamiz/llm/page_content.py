"""Separate the article of a page from the furniture around it.

Each page is read once by a streaming parser (``html.parser`` of the standard
library): block-level tags end a line, every tag event is counted on its line,
scripts and styles are skipped. Texts that reached us already without markup
keep their line structure, and what the markup has left behind counts in its
place: a line that recurs among the pages of its source (its template), separators
between labels, list marks before a headline, a line that is no finished
sentence, and, as a weak sign beside these, a known wording that addresses the
reader. Every line so gets a text-to-tag ratio: its words over its tag events.

Logarithms of the ratios are smoothed with a Gaussian over neighbouring lines
(blank lines and advertising set between paragraphs left aside) and split in two
clusters a page by 2-means, the threshold lying between the page's own means. Lines of plain evidence keep their
side; the smoothed cluster decides all others, so that a crosshead between two
paragraphs stays and a bare headline in a list of links goes.

Defined results: null and empty texts have no lines; blank lines are never
furniture; lines are numbered from 1 at every ``\\n``; very long lines are read
in full.
"""

from __future__ import annotations

import functools
import html.parser
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamiz.llm.line_blocks import MIN_DOCS, line_identifiers
from tamiz.session import broadcast_if_small, materialise

SIGMA = 1.0
RADIUS = 2
#: Means of the two clusters (log1p of words a tag, smoothed) from which a page's own ones are told, and the lines they weigh as.
HIGH_PRIOR, LOW_PRIOR, PRIOR = 2.4, 0.4, 1.0
#: Share of a source's documents that a line of its template is in, at least.
RECURRING = 0.001
#: Steps of 2-means.
STEPS = 2

# Labels of the sections of a news site.
SECTIONS = [
    "portada", "inicio", "última hora", "política", "economía", "mundo", "sociedad", "cultura", "deportes", "ciencia",
    "tecnología", "salud", "opinión", "gente", "viajes", "motor", "campo", "clasificados", "especiales", "podcasts",
    "videos", "vídeos", "hemeroteca", "el tiempo", "vivir", "internacional", "nacional", "local", "sucesos", "educación",
    "televisión", "fotos", "actualidad", "noticias", "negocios", "espectáculos", "ediciones", "archivo",
]
_SECTION = "(?:" + "|".join(re.escape(s).replace(r"\ ", r"\s+") for s in sorted(SECTIONS, key=len, reverse=True)) + ")"

# Wordings of page furniture, by kind (matched against a line in lower case).
WORDINGS = {
    "ad": [r"\W*(?:publicidad|anuncio|advertisement|publi)\W*", r"contenido patrocinado.*", r".*\bpatrocinado por\b.*"],
    "inline": [
        r"(?:lee también|lea también|leer también|te recomendamos|le recomendamos|además|también|mira también|relacionado|te puede interesar|read also|leia também|ver más)\s?:\s.*",
        r"(?:compartir|comparte|comparta|compártelo|guardar|imprimir|copiar enlace|enviar por)\b(?!.*\.$).*",
        r"comparte est[ae]\b.*",
    ],
    "cookies": [
        r".*\bcookies\b.*\b(?:tus?|acepta\w*|aceptarlas|terceros|navegación|audiencia)\b.*",
        r".*\b(?:nos permites|nos autorizas|nuestros socios|este portal|este sitio|esta página)\b.*\b(?:cookies|archivos|datos de tu)\b.*",
        r"(?:aceptar|acepto|entendido|rechazar|configurar|gestionar)\b[\w\s|·/,-]{0,60}", r"de acuerdo",
    ],
    "menu": [
        r"☰.*", r"(?:men[uú]|buscar|iniciar sesión|suscribirse|ingresar)(?:\s*[|·/,-]?\s*(?:men[uú]|buscar|iniciar sesión|suscríbete|ingresar|registrarse|mi cuenta))*",
        r"estás en:.*", r"ir a .{1,40} — volver a .*", r"volver (?:a|al) .{1,40}", r"usted está aquí.*",
    ],
    "byline": [
        r"(?:texto|firma|autor|autora|por|fotos?|redacta|escribe|edición|imagen|fotografía)\s?:\s.{2,80}", r".{0,60}\bredacción\b.{0,60}(?<![.])", r"de nuestr[oa]s? .{3,30} — .*",
        r"por la mesa de .*", r"por (?:la )?(?:redacción|agencia)\b.*",
    ],
    "counter": [
        r"[\d.,]+\s+(?:comentarios?|lecturas|visitas|veces compartid[oa]|me gusta|compartid[oa]s?)", r"leído [\d.,]+ veces", r"[\d.,]+ personas? est[áa]n? leyendo.*",
        r"tiempo de lectura\b.*", r"actualizado\b.{0,40}", r"publicado (?:el|a las|hace)\b.{0,40}", r"hace \d+ (?:minutos|horas|días)", r"\d+ min(?:utos)? de lectura",
    ],
    "subscribe": [
        r"(?:suscríbete|suscríbase|regístrate|regístrese|recibe|síguenos|síganos|apoya el|hazte socio|descarga nuestra|activa las|únete a)\b.*", r".*\bhazte socio\b.*",
        r"¿te gustó\?.*", r".*@[a-z0-9_]{4,}\W*",
    ],
    "related": [r"más sobre\b.{0,30}", r"(?:noticias|notas|artículos) relacionad[ao]s", r"también te puede interesar", r"te puede interesar", r"lo más (?:leído|visto|comentado|reciente)", r"(?:temas|etiquetas|tags|en esta nota|palabras clave)\s?:.*", r"sigue leyendo.{0,40}", r"más noticias.{0,30}"],
    "note": [
        r".*\b(?:material|información|datos) de la agencia\b.*\b(?:acuerdo|distribuid\w+|licencia)\b.*", r"serie especial\b.*", r"dossier\b.*", r"cobertura (?:especial )?(?:de|del)\b[^.]*", r"(?:especial|serie|entrega) (?:\d+|[ivx]+)\b.{0,60}",
        r".*\b(?:entrega para suscriptores|distribuido bajo acuerdo)\b.*",
    ],
    "legal": [
        r"©.*", r"\(c\) \d{4}.*", r".*\btodos los derechos reservados\b.*", r"(?:aviso legal|términos de uso|términos y condiciones|política de (?:privacidad|cookies)|mapa del sitio|privacidad)\b(?:[\s|·/,-]+(?:[^\s.]+\s?){0,4})*",
        r"prohibida la reproducción.*", r".*\bno se hace responsable de las opiniones\b.*", r"(?:calle|avenida|av\.|plaza|paseo) .{3,60}\btel\.?\s?[\d\s()+-]+", r".*\bfue verificada por nuestro equipo\b.*", r"trabaja con nosotros.*", r"quiénes somos.*", r"contacto\b.{0,40}",
    ],
}
_KINDS = [*WORDINGS]
_CUES = re.compile("|".join(f"(?P<{kind}>{'|'.join(patterns)})" for kind, patterns in WORDINGS.items()))
#: A finished sentence of more words is only held against the wordings if it has one of these.
_HINTS = ("cookies", "opiniones", "reservados", "reproducción", "editorial", "boletín", "archivos en tu", "datos de tu", "socio", "sin límites", "suscr", "agencia", "aviso legal", "©", "@", "patrocinado")
_SITE_SECTIONS = re.compile(rf"{_SECTION}(?:\s*[|·/»>:,—-]+\s*{_SECTION}|\s{{2,}}{_SECTION})*")
_BYLINE = re.compile(r"(?:[Pp]or|POR|[Bb]y)\s+(?:[A-ZÁÉÍÓÚÜÑ«][\w.«»'’-]*|de|del|la|y|e|/)(?:,?\s+(?:[A-ZÁÉÍÓÚÜÑ«][\w.«»'’-]*|de|del|la|y|e|/))*\s*")
_BYLINE_LOWER = re.compile(r"por\s+(?:\w+\.?\s+){1,5}\w+")
_ENDS, _CLOSERS = (".", "!", "?", "…"), "»”\"')]"
_CREDITED = re.compile(r"[.!?…][»”\"]?\s*\([^()]{3,120}\)$")
_INNER_END = re.compile(r"[.?!…][»”\"]? [A-ZÁÉÍÓÚÜÑ«¿¡\"“]")
_LINK_MARK = re.compile(r"(?:\d{1,2}[.)]|>>|»|›|→|▶|\+)\s+")
_LIST_MARK = re.compile(r"(?:[-–—•*·]|\d{1,2}[.)])\s+")
_SEPARATOR = re.compile(r" [|·/»>] |\s{3,}")
_SPACES = re.compile(r"\s+")

#: Sides of a line: furniture or article by its own evidence, open, or set between paragraphs (furniture, left aside in smoothing).
OUT, IN, OPEN, BETWEEN = 0, 1, 2, 3


class _Lines(html.parser.HTMLParser):
    """Streaming events of one page -> (text, tags) a line."""

    BLOCKS = frozenset("p div li ul ol br hr tr td th table h1 h2 h3 h4 h5 h6 header footer nav aside section article main form figure figcaption blockquote".split())
    SILENT = frozenset(["script", "style", "noscript", "template"])

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int]] = []
        self.text: list[str] = []
        self.tags = self.silent = 0
        self.number = 1

    def end_line(self) -> None:
        self.lines.append(("".join(self.text), self.tags, self.number))
        self.text, self.tags = [], 0
        self.number = self.getpos()[0]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in self.BLOCKS and "".join(self.text).strip():
            self.end_line()
        if not self.text:
            self.number = self.getpos()[0]
        self.tags += 1
        self.silent += tag in self.SILENT

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        self.silent = max(0, self.silent - (tag in self.SILENT))
        if tag in self.BLOCKS and "".join(self.text).strip():
            self.end_line()

    def handle_data(self, data: str) -> None:
        if self.silent:
            return
        first, *rest = data.split("\n")
        self.text.append(first)
        for k, piece in enumerate(rest, self.getpos()[0] + 1):
            self.end_line()
            self.text.append(piece)
            self.number = k


_MARKUP = re.compile(r"</?[a-zA-Z][^<>]*>")


def page_lines(page: str) -> list[tuple[str, int, int]]:
    """(text, tag events, number of the source line) of each line of a page; a text without markup keeps its own lines."""
    if "<" not in page or not _MARKUP.search(page):
        return [(x, 0, i) for i, x in enumerate(page.split("\n"), 1)]
    parser = _Lines()
    parser.feed(page)
    parser.close()
    parser.end_line()
    return parser.lines


def _has_end(text: str) -> bool:
    """Whether a trimmed line ends as a sentence does, closing marks or a credit in brackets left aside."""
    return text.rstrip(_CLOSERS).endswith(_ENDS) or text.endswith(")") and _CREDITED.search(text) is not None


@functools.lru_cache(maxsize=200_000)
def _evidence(line: str, tags: int) -> tuple[float, int]:
    """(log text-to-tag ratio, side) of one line, already trimmed."""
    text = " ".join(line.split())
    low = text.lower()
    words = low.count(" ") + 1
    ended = _has_end(text)
    long_prose = ended and words > 14
    if not long_prose or words <= 60 and any(hint in low for hint in _HINTS):
        cue = _CUES.fullmatch(low)
        if cue:
            kind = cue.lastgroup
            return 0.0, BETWEEN if kind in ("ad", "inline") else OUT
        if _SITE_SECTIONS.fullmatch(line.lower()) or _BYLINE.fullmatch(text) or (text.isupper() and _BYLINE_LOWER.fullmatch(low) and words < 8):
            return 0.0, OUT
    separators = len(_SEPARATOR.findall(line)) if not ended else 0
    if separators >= 2:
        return 0.0, OUT
    if _LINK_MARK.match(text) and not ended:
        return 0.0, OUT if text[0].isdigit() else BETWEEN
    # An unfinished sentence is what a label or a link leaves: it weighs as the tags around it.
    ratio = words / (1 + tags + (0 if ended else 4) + 3 * separators)
    if not ended and (words >= 18 or (words >= 12 and _INNER_END.search(text))):
        # Running text that only lacks its last full stop, or was cut off.
        return float(np.log1p(words / (1 + tags))), IN if tags <= words / 4 else OPEN
    if ended and words >= 4 and tags <= words / 4:
        return float(np.log1p(ratio)), IN
    return float(np.log1p(ratio)), OPEN if _LIST_MARK.sub("", text, count=1) else OUT


class _Pieces:
    """The non-blank pieces of the lines of some pages, and which of them belong to the article."""

    def __init__(self, pages: list[str | None], sites: list[str | None] | None, recurring: list | None):
        self.texts: list[str] = []
        values: list[float] = []
        sides: list[int] = []
        self.owner: list[int] = []
        self.number: list[int] = []
        template: list[bool] = []
        for k, page in enumerate(pages):
            if not page:
                continue
            site = _SPACES.sub(" ", sites[k]).strip().lower() if sites and sites[k] else None
            again = set(recurring[k]) if recurring and recurring[k] is not None else ()
            for text, tags, i in page_lines(page):
                bare = text.strip()
                if not bare:
                    continue
                value, side = _evidence(bare, tags)
                if site and side != OUT and len(bare) < len(site) + 40 and site in _SPACES.sub(" ", bare).lower() and not _has_end(bare):
                    value, side = 0.0, OUT
                if i in again and side not in (OUT, BETWEEN):
                    # What recurs among the pages of a site is its template: it weighs as a tag a word.
                    value, side = float(np.log1p(0.5)), OUT
                template.append(i in again)
                self.texts.append(bare)
                values.append(value)
                sides.append(side)
                self.owner.append(k)
                self.number.append(i)
        side, own = np.array(sides, dtype=np.int8), np.array(self.owner, dtype=np.int64)
        self.inside = _content(np.array(values), _set_between(side, own, np.array(template, dtype=bool)), own)


def _set_between(side: np.ndarray, own: np.ndarray, template: np.ndarray) -> np.ndarray:
    """Lines of the template that stand alone between two paragraphs are set between them."""
    if len(side) < 3:
        return side
    side = side.copy()
    alone = template[1:-1] & (side[1:-1] == OUT) & (side[:-2] == IN) & (side[2:] == IN) & (own[:-2] == own[2:])
    side[1:-1][alone] = BETWEEN
    return side


def furniture_flags(pages: list[str | None], sites: list[str | None] | None = None, recurring: list | None = None) -> list[np.ndarray]:
    """For each page, a mask over its lines: true where a non-blank line is furniture.

    ``recurring`` holds for each page the numbers of the lines that many pages of its site have.
    """
    pieces = _Pieces(pages, sites, recurring)
    sizes = [page.count("\n") + 1 if page else 0 for page in pages]
    # A source line that markup has cut into several is furniture if all its pieces are.
    seen, kept = [np.zeros(n, dtype=bool) for n in sizes], [np.zeros(n, dtype=bool) for n in sizes]
    for k, i, inside in zip(pieces.owner, pieces.number, pieces.inside, strict=True):
        seen[k][i - 1] = True
        kept[k][i - 1] |= inside
    return [a & ~b for a, b in zip(seen, kept, strict=True)]


def _thresholds(smooth: np.ndarray, page: np.ndarray, plain_in: np.ndarray, plain_out: np.ndarray) -> np.ndarray:
    """The value between the two clusters of each page's smoothed ratios, by 2-means.

    The means start from the lines of plain evidence. A page that has them on one
    side only starts from the mean of the other side over all pages at hand,
    ``PRIOR`` lines' worth of which stands in for it, and so does a small cluster.
    """
    n = int(page.max()) + 1 if len(page) else 0

    def means(lines: np.ndarray, prior: float) -> np.ndarray:
        return (np.bincount(page[lines], smooth[lines], n) + PRIOR * prior) / (np.bincount(page[lines], minlength=n) + PRIOR)

    high, low = means(plain_in, HIGH_PRIOR), means(plain_out, LOW_PRIOR)
    for _ in range(STEPS):
        above = (smooth > ((high + low) / 2)[page] if n else np.zeros(0, bool)) & ~plain_out | plain_in
        high, low = means(above, HIGH_PRIOR), means(~above, LOW_PRIOR)
    return (high + low) / 2


def _content(v: np.ndarray, side: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Mask of the lines that belong to the article."""
    content = side == IN
    if not len(v):
        return content
    seen = np.flatnonzero(side != BETWEEN)
    x, o = v[seen], own[seen]
    total, weight = np.zeros(len(x)), np.zeros(len(x))
    for step in range(-RADIUS, RADIUS + 1):
        w = float(np.exp(-(step**2) / (2 * SIGMA**2)))
        if abs(step) >= len(x) and step:
            continue
        here = slice(max(0, -step), len(x) - max(0, step))
        there = slice(max(0, step), len(x) - max(0, -step))
        same = o[here] == o[there]
        total[here] += np.where(same, w * x[there], 0.0)
        # Beyond the ends of a page lies no text: its ratio is 0.
        weight[here] += w
        weight[: here.start] += w
        weight[here.stop :] += w
    smooth = total / weight.clip(min=1e-9)
    plain_in = side[seen] == IN
    threshold = _thresholds(smooth, o, plain_in, side[seen] == OUT)
    unclear = side[seen] == OPEN
    content[seen[unclear]] = smooth[unclear] > threshold[o[unclear]]
    # A page without furniture has one cluster: an open line beside a paragraph is its part.
    following = np.zeros(len(x), dtype=bool)
    following[1:] = (o[1:] == o[:-1]) & (plain_in[:-1])
    last = np.ones(len(x), dtype=bool)
    last[:-1] = o[1:] != o[:-1]
    content[seen[unclear & following & last]] = True
    return content


_TITLE_TAIL = re.compile(r"\s+(?:\||—|–|-|::|·|»|/)\s+([^|—–:·»]+)$")
_TITLE_HEAD = re.compile(rf"\s*{_SECTION}\s*(?:·|\||/|»|>|::|—|–|-|:)\s+\S", re.IGNORECASE)


def title_has_furniture(title: str | None, site: str | None, sites: frozenset[str]) -> bool:
    """Whether a title carries a site's name or a section label besides the headline."""
    if not title or not title.strip():
        return False
    tail = _TITLE_TAIL.search(title.rstrip())
    if tail:
        name = _SPACES.sub(" ", tail.group(1)).strip().lower()
        if name == (site or "").lower() or name in sites or re.fullmatch(_SECTION, name):
            return True
    head = re.match(r"\s*(.+?)\s+(?:\||—|–|-|::|·|»)\s+\S", title)
    if head and _SPACES.sub(" ", head.group(1)).strip().lower() in sites:
        return True
    return _TITLE_HEAD.match(title) is not None


def with_recurring(df: DataFrame, ident: str, text: str, source: Column, out: str, min_docs: int = MIN_DOCS, share: float = RECURRING) -> DataFrame:
    """Add ``out``: the numbers of the lines of each text that recur among the documents of its source.

    A line recurs in ``min_docs`` documents or more and in ``share`` of the
    source's, so that a story told again makes no template of its lines at any size.
    """
    lines = materialise(line_identifiers(df, ident, text, source), "lines")
    sizes = lines.groupBy("src").agg(F.count("*").alias("_n"))
    counted = lines.select("src", F.explode(F.array_distinct("ids.key")).alias("key")).groupBy("src", "key").agg(F.count("*").alias("_k")).where(F.col("_k") >= min_docs)
    often = counted.join(broadcast_if_small(sizes), "src").where(F.col("_k") >= share * F.col("_n")).select("src", "key")
    each = lines.select("doc", "src", F.explode("ids").alias("_l")).select("doc", "src", F.col("_l.key").alias("key"), F.col("_l.linea").alias("linea"))
    held = each.join(broadcast_if_small(often), ["src", "key"]).groupBy("doc").agg(F.collect_set("linea").alias(out))
    held = held.withColumnRenamed("doc", "_held_doc")
    return df.join(broadcast_if_small(materialise(held, "recurring")), df[ident].cast("long") == F.col("_held_doc"), "left").drop("_held_doc")


def furniture_lines(text: Column, title: Column, site: Column, sites: frozenset[str], recurring: Column | None = None) -> Column:
    """Array of the numbers of furniture lines: 0 for the title, from 1 for lines of ``text``."""

    @F.pandas_udf("array<int>")
    def found(texts: pd.Series, titles: pd.Series, names: pd.Series, again: pd.Series) -> pd.Series:
        out = []
        for flags, title, name in zip(furniture_flags(texts.tolist(), names.tolist(), again.tolist()), titles, names, strict=True):
            numbers = (np.flatnonzero(flags) + 1).tolist()
            out.append([0, *numbers] if title_has_furniture(title, name, sites) else numbers)
        return pd.Series(out)

    return found(text, title, site, _none_recur() if recurring is None else recurring)


def article_of(pages: list[str | None], recurring: list | None = None) -> list[list[str]]:
    """The non-blank lines of each page's article, in order, without markup (pieces of one source line by themselves)."""
    out: list[list[str]] = [[] for _ in pages]
    pieces = _Pieces(pages, None, recurring)
    for k, text, inside in zip(pieces.owner, pieces.texts, pieces.inside, strict=True):
        if inside:
            out[k].append(text)
    return out


def _none_recur() -> Column:
    return F.lit(None).cast("array<int>")


def article_text(text: Column, recurring: Column | None = None) -> Column:
    """The article of each page as one string with its lines; null stays null."""

    @F.pandas_udf("string")
    def article(texts: pd.Series, again: pd.Series) -> pd.Series:
        pages = texts.tolist()
        return pd.Series([None if p is None else "\n".join(x) for p, x in zip(pages, article_of(pages, again.tolist()), strict=True)], dtype=object)

    return article(text, _none_recur() if recurring is None else recurring)


def is_furniture_wording(line: str) -> bool:
    """Whether a line by itself, without its neighbours, is furniture."""
    return bool(line.strip()) and _evidence(line.strip(), 0)[1] in (OUT, BETWEEN)
