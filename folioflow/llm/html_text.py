"""Main text of web pages by consensus host paths.

(1) Each page's containers are scored: words of running text in blocks directly under the container (links count against
it), by generalised path, i.e. the tags from the root with their classes, digits in class names replaced by 0.  (2) Spark adds the
scores of each path over the pages of a host; pages vote, and the best path of the host wins.  (3) Each page is extracted again
from the containers on the winning path, or rather from the article, main element or parent of sections that they are part of; a page that has none there, or no text in it, uses its own best container, and then its body.

Regions that are no article text (menus, page headers, footers, sidebars, notices, adverts, forms, scripts, styles, reader
comments) are left out by tag, role or, for blocks, class word wherever they are.
"""

from __future__ import annotations

import html as _html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import written

#: Hosts that may be broadcast; with more, pages meet their host's path in a shuffle join.
BROADCAST_HOSTS = 100_000
# Elements by their role in HTML, and class or id words of regions that are no article text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes".split())
DROPPED = frozenset("script style noscript template iframe object svg canvas head title nav footer aside form button select option textarea input dialog menu audio video map".split())
BLOCKS = frozenset("address article blockquote body caption center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 header hr html legend li main ol p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINERS = frozenset("article body div main section td center".split())
#: An open element of the first name ends when one of the named ones begins.
CLOSED_BY = {"p": frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"])}
NOISE = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adsense banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright disqus footer footnav gdpr header login masthead menu menubar modal nav navbar navigation "
    "newsletter notice notices notification pager paginate pagination popup promo promos promotion related respond share sharing sidebar sidenav signup skip social sponsor sponsored subscribe tagcloud toolbar topbar widget widgets".split()
)
NOISE_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|\Z)|[^<]+|<", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z][\w:-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPACE = re.compile(r"\s+")
#: Class words that say something about another region, such as has-sidebar.
_ABOUT = re.compile(r"(?:has|no|not|with|without|is)[-_]|.*[-_](?:with|without|has|no)[-_]", re.I)
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Za-z][a-z]*|\d+")
#: Words that make a header with such a class the article's own.
_OWN = frozenset("article entry post story content title".split())


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): _html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(text)} if text and not text.isspace() else {}


def _noise(tag: str, attributes: dict[str, str], inside: bool) -> bool:
    """Whether an element is no article text.  Class words count for blocks only; inside an article a header holds its title."""
    if tag in DROPPED:
        return True
    if not attributes:
        return False
    if "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or attributes.get("role", "").lower() in NOISE_ROLES:
        return True
    if re.search(r"display\s*:\s*none", attributes.get("style", ""), re.I):
        return True
    if tag in ("html", "body", "article", "main") or tag not in BLOCKS:
        return False
    names = [x for x in f"{attributes.get('class', '')} {attributes.get('id', '')}".split() if not _ABOUT.match(x)]
    heading = tag == "header" or len(tag) == 2 and tag[0] == "h" and tag[1].isdigit()
    for x in names:
        words = {w.lower() for w in _WORDS.findall(x)}
        if words & NOISE - ({"header"} if heading or inside or words & _OWN else set()):
            return True
    return False


def blocks(html: str) -> tuple[list[tuple[str, str, int]], dict[str, list[float]]]:
    """The page's text blocks in order, (text, path of containers from the root, link characters), and each container's score.

    A path is the generalised path of the nearest container; a block belongs to all containers whose path starts its path.
    """
    out: list[tuple[str, str, int]] = []
    stack: list[tuple[str, str, bool]] = []  # tag, generalised path of the nearest container, dropped
    parts: list[str] = []
    links = in_link = 0

    def flush() -> None:
        nonlocal links
        if parts:
            text = _SPACE.sub(" ", "".join(parts)).strip()
            if text:
                out.append((text, stack[-1][1] if stack else "", links))
            parts.clear()
        links = 0

    def close(upto: int) -> None:
        nonlocal in_link
        while len(stack) > upto:
            if stack[-1][0] in BLOCKS:
                flush()
            in_link -= stack[-1][0] == "a"
            stack.pop()

    at, n = 0, len(html)
    while at < n:
        m = _TOKEN.match(html, at)
        at = m.end()
        tag = m[2]
        if tag is None:
            text = m[0]
            if text.startswith("<![CDATA["):
                continue
            if (text[0] != "<" or text == "<") and not (stack and stack[-1][2]):
                text = _html.unescape(text)
                parts.append(text)
                if in_link:
                    links += len(text)
            continue
        tag = tag.lower()
        if m[1]:
            if tag == "br":
                parts.append(" ")
                continue
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    close(k)
                    break
            continue
        if tag in VOID:
            if not (stack and stack[-1][2]):
                if tag == "hr":
                    flush()
                elif tag != "wbr":
                    parts.append(" ")
            continue
        for k in range(len(stack) - 1, max(-1, len(stack) - 6), -1):
            ended = CLOSED_BY.get(stack[k][0])
            if ended and tag in ended:
                close(k)
                break
            if stack[k][0] in CONTAINERS or stack[k][0] in ("ul", "ol", "dl", "table"):
                break
        if tag == "body":  # what a broken head has left open
            close(next((k + 1 for k, x in enumerate(stack) if x[0] == "html"), 0))
        if tag in BLOCKS:
            flush()
        attributes = _attributes(m[3])
        path = stack[-1][1] if stack else ""
        # a header inside an article holds its title; one outside is the page's
        inside = any(x[0] in ("article", "main") for x in stack)
        dropped = bool(stack and stack[-1][2]) or _noise(tag, attributes, inside) or (tag == "header" and not inside)
        if tag in CONTAINERS:
            classes = ".".join(sorted(re.sub(r"\d+", "0", c) for c in attributes.get("class", "").split()))
            path = f"{path}>{tag}{'.' + classes if classes else ''}"
        stack.append((tag, path, dropped))
        in_link += tag == "a"
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(html, at)
            body, at = html[at : end.start() if end else n], end.start() if end else n
            if not dropped:
                parts.append(_html.unescape(body) if tag in ("textarea", "title") else "")
        if m[3].endswith("/") and tag not in BLOCKS and tag not in ("a", "b", "i", "em", "span", "strong"):
            close(len(stack) - 1)
    close(0)
    flush()
    scores: dict[str, list[float]] = {}
    for text, path, linked in out:
        worth = len(text.split()) * (1 - 2 * min(1.0, linked / len(text)))
        up, share = path, 1.0
        while up and share > 0.2:  # parents get a part of it, so a container of several sections can win
            scores.setdefault(up, [0.0])[0] += worth * share
            up, share = up.rpartition(">")[0], share * 0.6
    return out, scores


def whole(found: list[tuple[str, str, int]], at: str) -> str:
    """The container whose part the best one is: the article around it; then the main element around that, or the parent of a section, as long as what is added is running text rather than links."""
    names = at.split(">")
    tags = [x.split(".")[0] for x in names]
    end = max((k + 1 for k, x in enumerate(tags) if x == "article"), default=len(tags))
    while end > 2:
        up = max((k + 1 for k, x in enumerate(tags[: end - 1]) if x == "main"), default=end - 1 if tags[end - 1] == "section" else 0)
        if not up:
            break
        inner, outer = ">".join(names[:end]), ">".join(names[:up])
        added = [(t, linked) for t, p, linked in found if (p == outer or p.startswith(outer + ">")) and p != inner and not p.startswith(inner + ">")]
        if added and sum(len(t.split()) * (1 - 2 * min(1.0, linked / len(t))) for t, linked in added) <= 0:
            break
        end = up
    return ">".join(names[:end])


def text_at(found: list[tuple[str, str, int]], scores: dict[str, list[float]], path: str | None) -> str:
    """The blocks of the whole article around the path, joined by line feeds; of that around the page's own best container if there are none under the path."""
    under = lambda at: [t for t, p, _ in found if p == at or p.startswith(at + ">") or not at]
    for at in (path, max(scores, key=lambda p: (scores[p][0], p)) if scores else None, ""):
        if at is not None and under(at):
            return "\n".join(under(whole(found, at)))
    return ""


def _votes(batches):
    for batch in batches:
        total: dict[tuple[str, str], float] = {}
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            _, scores = blocks(page)
            if scores:
                best = max(x[0] for x in scores.values())
                for p, (s,) in scores.items():
                    if best > 0 and s > 0:
                        total[host, p] = total.get((host, p), 0.0) + s / best  # a page's votes add up alike, however long it is
        keys = list(total)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([round(total[k] * 1e6) for k in keys], pa.int64())], ["host", "path", "votes"])


def _extract(columns: list[str]):
    def run(batches):
        for batch in batches:
            pages, paths = batch.column("__html").to_pylist(), batch.column("__path").to_pylist()
            texts = [text_at(*blocks(h), p) for h, p in zip(pages, paths)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*columns, "text", "n_chars"])

    return run


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row (id_col, url_col, text, n_chars) per row of pages.

    Null or empty HTML has an empty text.  The host is the part of the URL between // and the next /, ? or #, in lower case; pages
    without a URL share the empty host.  Repeated rows get a row each and vote each; ties between paths go to the
    greater path.  An empty table gives an empty one; other columns aren't read, whatever their names.
    """
    host = F.lower(F.regexp_extract(F.coalesce(url_col, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    rows = pages.select(F.col(id_col), F.col(url_col), F.coalesce(html_col, F.lit("")).alias("__html"), host.alias("__host"))
    votes = rows.select("__host", "__html").mapInArrow(_votes, "host string, path string, votes long")
    best = votes.groupBy("host", "path").agg(F.sum("votes").alias("votes")).groupBy("host").agg(F.max_by("path", F.struct("votes", "path")).alias("__path"))
    best = written(best, "paths").withColumnRenamed("host", "__best")
    found = F.broadcast(best) if best.count() <= BROADCAST_HOSTS else best
    met = rows.join(found, F.col("__host") == F.col("__best"), "left").select(id_col, url_col, "__html", "__path")
    types = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    return met.mapInArrow(_extract([id_col, url_col]), f"`{id_col}` {types[id_col]}, `{url_col}` {types[url_col]}, text string, n_chars long")


