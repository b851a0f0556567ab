"""Facts and content signals of HTML pages: one pass of a tolerant reader, the rest as column expressions."""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser
from itertools import islice
from urllib.parse import unquote, urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citewise.functions import exprs as E
from citewise.functions import text as X

FACTS = (
    "lang string, title string, description string, canonical string, n_canonicals int, robots string, viewport string, refresh string, h1s array<string>, headings array<struct<level: int, text: string>>,"
    " n_images int, n_missing_alt int, n_missing_size int, links array<string>, nav_links array<string>, n_internal int, n_external int, n_nofollow int, n_generic_anchors int, og map<string, string>, twitter map<string, string>,"
    " hreflang array<struct<lang: string, href: string>>, has_favicon boolean, has_breadcrumb boolean, json_ld_types array<string>, n_json_ld_errors int, n_paragraphs int, n_mixed int, script_chars int, html_chars int, n_dated int,"
    " mount_chars int, text string, main_text string, blocks array<struct<kind: string, text: string>>, externals array<string>, link_positions array<int>, images array<string>, n_lists int, n_ordered int, n_list_items int, n_tables int,"
    " n_interstitials int, authors array<string>, author_in_schema boolean, byline_marked boolean, published array<string>, modified array<string>, org_name string, n_same_as int, has_faq_type boolean, has_email boolean, has_phone boolean,"
    " has_address boolean"
)
# Elements without end tags, those whose text isn't read, those outside the main text, anchors that say nothing.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
SILENT = frozenset("script style noscript template svg".split())
CHROME = frozenset("nav header footer aside".split())
CHROME_ROLES = frozenset("navigation banner contentinfo complementary".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
GENERIC = frozenset("click here,here,read more,learn more,more,this,link,this page,details".split(","))
BLOCKS = frozenset("p div section article li ul ol h1 h2 h3 h4 h5 h6 td th tr table br title blockquote pre header footer nav aside main body".split())
KINDS = {"p": "p", "li": "li", "pre": "pre", "td": "cell", "th": "cell", "blockquote": "p", **dict.fromkeys(HEADINGS, "h")}
MOUNTS = frozenset("root app __next __nuxt svelte main-app".split())
OVERLAY = re.compile(r"\b(?:popup|pop-up|modal|overlay|interstitial|lightbox)", re.I)
NO_OVERLAY = re.compile(r"cookie|consent|gdpr|ccpa|search|menu|navbar|cart|video|share|gallery|zoom|login|log-in|signin|sign-in|auth|account|quick-?view|(?:multi|bi|uni|cross|tri)modal|modalit", re.I)
STOCK_HOSTS = ("pexels.com", "unsplash.com", "shutterstock.com", "istockphoto.com", "gettyimages.com", "stock.adobe.com", "ftcdn.net", "depositphotos.com", "dreamstime.com", "pixabay.com", "123rf.com", "alamy.com", "freepik.com")
STOCK_FILE = re.compile(r"(?:shutterstock|istock|gettyimages|adobestock|depositphotos|dreamstime|unsplash|pexels|pixabay|freepik)", re.I)
FOREIGN_IMAGES = tuple(
    "media-amazon.com ssl-images-amazon.com images-amazon.com ebayimg.com walmartimages.com etsystatic.com alicdn.com giphy.com tenor.com shields.io badgen.net gravatar.com ytimg.com vimeocdn.com twimg.com fbcdn.net "
    "cdninstagram.com pinimg.com redd.it redditmedia.com redditstatic.com licdn.com tiktokcdn.com mzstatic.com w.org doubleclick.net googlesyndication.com googleadservices.com adsrvr.org".split()
)
DECORATION = re.compile(r"(?:^|[-_.])(?:avatars?|emoji|icons?|logos?|favicon|badges?|spinner|loader|placeholder|pixel|spacer|blank)(?:[-_.]|$)", re.I)
DATE = re.compile(r"\b(?:\d{4}-\d{2}-\d{2}|(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?\s+\d{1,2},?\s+\d{4}|\d{1,2}\s+(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?\s+\d{4})\b", re.I)
MAIL = re.compile(r"(?<![\w.%+-])[\w.%+-]+@[\w-]+(?:\.[\w-]+)*\.[a-z]{2,}", re.I)
DIALLED = re.compile(r"\+?\(?\d[\d\s().-]{7,18}\d")
_WORD = re.compile(r"[^\W_]+(?:['’.\-][^\W_]+)*")


def _within(host: str, domains: tuple[str, ...]) -> bool:
    return any(host == d or host.endswith("." + d) for d in domains)


def image_origin(src: str, host: str) -> str:
    """stock, third-party or own, by the image's host and file, read through two layers of escapes and proxies' parameters."""
    plain = unquote(unquote(src)).lower()
    hosts = re.findall(r"https?://([^/?#]+)", plain)
    if any(_within(h.removeprefix("www."), STOCK_HOSTS) for h in hosts) or STOCK_FILE.search(plain.split("?")[0].rsplit("/", 1)[-1]) or any(STOCK_FILE.search(v.rsplit("/", 1)[-1]) for v in re.findall(r"[?&](?:url|src|image|img)=([^&#]+)", plain)):
        return "stock"
    if not hosts:
        return "third-party"
    root = ".".join(host.split(".")[-2:])
    if hosts[0] == root or hosts[0].endswith("." + root):
        return "own"
    return "third-party" if _within(hosts[0], FOREIGN_IMAGES) else "own"


def absolute(base: str, href: str) -> str | None:
    """href joined to base; null where that is no address, as with an open bracket in the host."""
    try:
        whole = urljoin(base, href)
        urlsplit(whole)
    except ValueError:
        return None
    return whole


def whole_text(text: str) -> str:
    """text with halves of surrogate pairs, which JSON's escapes can name, replaced."""
    return text.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")


class _Page(HTMLParser):
    def __init__(self, url: str):
        super().__init__(convert_charrefs=True)
        url = absolute("", url) or ""
        self.url = url
        self.host = (urlsplit(url).hostname or "").removeprefix("www.")
        self.r: dict = {k: None for k in ("lang", "title", "description", "canonical", "robots", "viewport", "refresh", "org_name", "mount_chars")}
        self.r |= {k: [] for k in ("h1s", "headings", "links", "nav_links", "hreflang", "json_ld_types", "blocks", "externals", "link_positions", "images", "authors", "published", "modified")} | {"og": {}, "twitter": {}}
        self.r |= {k: 0 for k in ("n_canonicals", "n_images", "n_missing_alt", "n_missing_size", "n_internal", "n_external", "n_nofollow", "n_generic_anchors", "n_json_ld_errors", "n_paragraphs", "n_mixed", "script_chars", "n_dated", "n_lists", "n_ordered", "n_list_items", "n_tables", "n_interstitials", "n_same_as")}
        self.r |= {k: False for k in ("has_favicon", "has_breadcrumb", "author_in_schema", "byline_marked", "has_faq_type", "has_email", "has_phone", "has_address")}
        self.stack: list[tuple[str, bool]] = []
        self.open: dict[str, int] = {}  # how many of each tag, and how many outside the main text, are on the stack
        self.chrome = 0
        self.text: list[str] = []
        self.main: list[str] = []
        self.counted = self.main_words = 0  # pieces of the main text whose words are counted, and their words
        self.held: dict[str, list[str]] = {}
        self.anchor: tuple[bool, bool] | None = None
        self.block: tuple[str, int] | None = None
        self.mount: int | None = None
        self.ld = False

    def first(self, key: str, value: str | None) -> None:
        if value and self.r[key] is None:
            self.r[key] = " ".join(value.split())

    @property
    def in_chrome(self) -> bool:
        return self.chrome > 0

    def inside(self, tags) -> bool:
        return any(map(self.open.get, tags))

    def words_so_far(self) -> int:
        """Words of the main text's pieces up to here; each piece is counted once, whatever the number of links."""
        for piece in islice(self.main, self.counted, None):
            self.main_words += len(_WORD.findall(piece))
        self.counted = len(self.main)
        return self.main_words

    def parse_marked_section(self, i, report=1):
        """A section of no known keyword, as text that damage put after <! makes it, is a comment up to the next >."""
        try:
            return super().parse_marked_section(i, report)
        except AssertionError:
            return self.parse_bogus_comment(i, report)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def meta(self, a: dict) -> None:
        r, name, prop, item, content = self.r, a.get("name", "").strip().lower(), a.get("property", "").strip().lower(), a.get("itemprop", "").strip().lower(), a.get("content", "").strip()
        if name in ("description", "viewport"):
            self.first(name, content)
        elif name in ("robots", "googlebot"):
            self.first("robots", content)
        if a.get("http-equiv", "").lower() == "refresh" and "url=" in content.lower().replace(" ", ""):
            self.first("refresh", content)
        for box, start in (("og", "og:"), ("twitter", "twitter:")):
            for key in (prop, name):
                if key.startswith(start):
                    r[box].setdefault(key[len(start) :], content)
        key = prop or name
        if content:
            if name == "author" or key == "article:author" or "author" in item.split():
                r["byline_marked"] = True
                r["authors"].append(content)
            if key == "article:published_time" or item == "datepublished":
                r["published"].append(content)
            elif key in ("article:modified_time", "og:updated_time") or item == "datemodified":
                r["modified"].append(content)

    def link(self, a: dict) -> None:
        rel = a.get("rel", "").lower().split()
        if "canonical" in rel:
            self.r["n_canonicals"] += 1
            self.first("canonical", (absolute(self.url, a.get("href", "")) or "").partition("#")[0])
        if "icon" in rel or "apple-touch-icon" in rel:
            self.r["has_favicon"] = True
        if "alternate" in rel and a.get("hreflang"):
            self.r["hreflang"].append((a["hreflang"], absolute(self.url, a.get("href", "")) or a.get("href", "")))

    def image(self, a: dict) -> None:
        r = self.r
        r["n_images"] += 1
        r["n_missing_alt"] += "alt" not in a
        r["n_missing_size"] += "width" not in a or "height" not in a
        src = next((a[k].strip() for k in ("data-src", "data-lazy-src", "data-original", "src") if a.get(k, "").strip() and not a[k].strip().lower().startswith("data:")), "")
        size = [int(a[k].lstrip("0")[:9] or 0) for k in ("width", "height") if a.get(k, "").isdecimal()]  # nine digits are large, whatever follows
        small = any(s <= 2 for s in size) or (len(size) == 2 and max(size) <= 64)
        if src and not small and not self.in_chrome and not DECORATION.search(src.rsplit("/", 1)[-1].split("?")[0]):
            r["images"].append(image_origin(absolute(self.url, src) or src, self.host))

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in reversed(attrs)}
        r = self.r
        if tag in HEADINGS:  # a heading left open ends where the next begins
            for other in HEADINGS.intersection(self.held):
                self.handle_endtag(other)
        if tag == "html":
            self.first("lang", a.get("lang"))
        elif tag == "meta":
            self.meta(a)
        elif tag == "link":
            self.link(a)
        elif tag == "img":
            self.image(a)
        elif tag == "p":
            r["n_paragraphs"] += 1
        elif tag == "a" and "href" in a:
            to = urlsplit(absolute(self.url, a["href"].strip()) or "")
            if to.scheme in ("http", "https"):
                own = (to.hostname or "").removeprefix("www.") == self.host
                where = f"{to.scheme}://{to.netloc}{to.path}" + (f"?{to.query}" if to.query else "")
                r["n_internal" if own else "n_external"] += 1
                if own:
                    r["n_nofollow"] += "nofollow" in a.get("rel", "").lower().split()
                    r["links"].append(where)
                    r["nav_links"].append(where) if self.inside(("nav", "header", "footer")) else r["link_positions"].append(self.words_so_far())
                elif not self.in_chrome:
                    r["externals"].append(where)
                self.anchor = (own, True)
            if a["href"].lower().startswith("mailto:"):
                r["has_email"] = r["has_email"] or bool(MAIL.search(a["href"]))
            elif a["href"].lower().startswith("tel:"):
                r["has_phone"] = r["has_phone"] or sum(map(str.isdigit, a["href"])) >= 7
            if "author" in a.get("rel", "").lower().split():
                r["byline_marked"] = True
        if not self.in_chrome:
            r["n_lists"] += tag in ("ul", "ol")
            r["n_ordered"] += tag == "ol"
            r["n_list_items"] += tag == "li"
            r["n_tables"] += tag == "table"
        item = a.get("itemtype", "") + " " + a.get("typeof", "")
        r["has_breadcrumb"] |= "BreadcrumbList" in item
        r["has_faq_type"] |= "FAQPage" in item
        r["has_address"] |= "PostalAddress" in item or tag == "address"
        marks = f"{a.get('class', '')} {a.get('id', '')}"
        if tag == "dialog" or (OVERLAY.search(marks) and not NO_OVERLAY.search(marks)):
            r["n_interstitials"] += 1
        if re.search(r"(?:^|[\s_-])(?:byline|author)(?:$|[\s_-])", marks, re.I) or "author" in a.get("itemprop", "").split():
            r["byline_marked"] = True
        if tag == "time" and a.get("datetime"):
            (r["modified"] if "modified" in a.get("itemprop", "").lower() or "updated" in marks.lower() else r["published"]).append(a["datetime"])
        if self.url.startswith("https:") and tag != "a" and any(a.get(k, "").strip().lower().startswith("http:") for k in ("src", "poster")) or (tag == "link" and self.url.startswith("https:") and a.get("href", "").lower().startswith("http:") and "stylesheet" in a.get("rel", "").lower()) or (self.url.startswith("https:") and re.search(r"(?:^|,)\s*http:", a.get("srcset", ""))):
            r["n_mixed"] += 1
        if a.get("id") in MOUNTS and r["mount_chars"] is None:
            r["mount_chars"], self.mount = 0, len(self.stack)
        if tag == "script":
            self.ld = "ld+json" in a.get("type", "").lower()
            r["script_chars"] += len(self.get_starttag_text() or "")
        if tag not in VOID:
            self.stack.append((tag, chrome := tag in CHROME or a.get("role", "").lower() in CHROME_ROLES))
            self.open[tag] = self.open.get(tag, 0) + 1
            self.chrome += chrome
        if tag in BLOCKS:
            self.end_block()
            self.text.append(" ")
            self.main.append(" ")
            if tag in KINDS and not self.in_chrome:
                self.block = (KINDS[tag], len(self.main))
        if tag in ("title", "a", "time", "p", "h1", "h2", "h3", "h4", "h5", "h6", "script"):
            self.held[tag] = []

    def end_block(self) -> None:
        if self.block:
            kind, at = self.block
            got = " ".join("".join(self.main[at:]).split())
            if got:
                self.r["blocks"].append((kind, got))
            self.block = None

    def handle_endtag(self, tag):
        if self.open.get(tag):
            last = None
            while last != tag:
                last, chrome = self.stack.pop()
                self.open[last] -= 1
                self.chrome -= chrome
            if self.mount is not None and len(self.stack) <= self.mount:
                self.mount = None
        was_held = tag in self.held
        got = " ".join("".join(self.held.pop(tag, [])).split())
        if tag == "title":
            self.first("title", got)
        elif tag == "a" and self.anchor:
            self.r["n_generic_anchors"] += re.sub(r"^[\W_]+|[\W_]+$", "", got.lower()) in GENERIC
            self.anchor = None
        elif tag in ("p", "time") and was_held:
            self.r["n_dated"] += bool(DATE.search(got))
        elif tag in HEADINGS and was_held:
            self.r["headings"].append((int(tag[1]), got))
            if tag == "h1":
                self.r["h1s"].append(got)
        elif tag == "script" and self.ld:
            self.ld = False
            try:
                self.walk(json.loads(got))
            except (ValueError, RecursionError):
                self.r["n_json_ld_errors"] += 1
        if tag in BLOCKS:
            self.end_block()
            self.text.append(" ")
            self.main.append(" ")

    def walk(self, value) -> None:
        r, todo = self.r, [value]
        text = lambda v: whole_text(v) if isinstance(v, str) else None
        name = lambda v: text(v.get("name") if isinstance(v, dict) else v)
        while todo:
            v = todo.pop()
            if isinstance(v, list):
                todo += reversed(v)
            elif isinstance(v, dict):
                kind = v.get("@type")
                own = [whole_text(k) for k in (kind if isinstance(kind, list) else [kind]) if isinstance(k, str)]
                r["json_ld_types"] += [k for k in own if k not in r["json_ld_types"]]
                if any(k.endswith("Organization") or k in ("LocalBusiness", "Corporation") for k in own):
                    self.first("org_name", name(v))
                    same = v.get("sameAs")
                    r["n_same_as"] = max(r["n_same_as"], len(same) if isinstance(same, list) else int(isinstance(same, str)))
                for author in v.get("author") if isinstance(v.get("author"), list) else [v.get("author")]:
                    if isinstance(name(author), str):
                        r["authors"].insert(0, name(author))
                        r["author_in_schema"] = True
                if isinstance(v.get("datePublished"), str):
                    r["published"].insert(0, text(v["datePublished"]))
                if isinstance(v.get("dateModified"), str):
                    r["modified"].insert(0, text(v["dateModified"]))
                r["has_faq_type"] |= "FAQPage" in own
                r["has_breadcrumb"] |= "BreadcrumbList" in own
                r["has_address"] |= "PostalAddress" in own
                todo += reversed([x for x in v.values() if isinstance(x, (dict, list))])

    def handle_data(self, data):
        for held in self.held.values():
            held.append(data)
        if self.inside(("script",)):
            self.r["script_chars"] += len(data)
        if not self.inside(SILENT) and not self.inside(("head", "title")):
            self.text.append(data)
            if self.mount is not None:
                self.r["mount_chars"] += len(data.strip())
            if not self.in_chrome:
                self.main.append(data)


def page_facts(html: str, url: str = "") -> dict:
    """The facts of one page; damaged HTML is read as far as it goes, whatever its length.

    Links and canonicals that are no address are left out (canonicals are counted), alternates and pictures taken as they
    stand; JSON-LD that is damaged, or nested deeper than the reader goes, counts as an error.
    """
    p = _Page(url)
    digits = sys.get_int_max_str_digits()
    sys.set_int_max_str_digits(0)  # a character's number, or one in JSON-LD, may have any length
    try:
        p.feed(html)
        p.close()
        for tag in list(p.held):
            p.handle_endtag(tag)
    finally:
        sys.set_int_max_str_digits(digits)
    p.end_block()
    text = " ".join("".join(p.text).split())
    mail = p.r["has_email"] or bool(MAIL.search(text))
    phone = p.r["has_phone"] or any(9 <= sum(map(str.isdigit, m[0])) <= 15 and not DATE.match(m[0]) for m in DIALLED.finditer(text))
    return p.r | {"html_chars": len(html), "text": text, "main_text": " ".join("".join(p.main).split()), "has_email": mail, "has_phone": phone}


#: Characters of pages whose facts leave the reader together.
BLOCK_CHARS = 1_000_000


def fact_frames(frames: Iterable[pd.DataFrame], columns: list[str], chars: int = BLOCK_CHARS) -> Iterator[pd.DataFrame]:
    """columns (key, facts, and what else the frames have) of each page of frames of key, html, url, in blocks of chars characters of pages or one page more."""
    pairs = {"headings": ("level", "text"), "hreflang": ("lang", "href"), "blocks": ("kind", "text")}
    out, size = [], 0
    for pdf in frames:
        more = [c for c in pdf.columns if c not in ("key", "html", "url")]
        for k, h, u, *rest in zip(pdf["key"], pdf["html"], pdf["url"], *(pdf[c] for c in more), strict=True):
            r = page_facts(h, u or "") if h else {}
            for c, names in pairs.items() if r else ():
                r[c] = [dict(zip(names, x, strict=True)) for x in r[c]]
            out.append({**dict.fromkeys(columns), **r, "key": k, **dict(zip(more, rest, strict=True))})
            size += len(h or "")
            if size >= chars:
                yield pd.DataFrame(out, columns=columns, dtype=object)
                out, size = [], 0
        if out:
            yield pd.DataFrame(out, columns=columns, dtype=object)
            out, size = [], 0


def parse_pages(df: DataFrame, key: str, html: str, url: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """key (string), FACTS and the text columns keep of each page; null and empty pages have null facts. One narrow pass over whole pages.

    links holds every link to the same host as it stands, nav_links those in menus, headers and footers; images the origin
    of each picture in the main text that is no decoration; blocks the main text's runs by kind (p, li, h, cell, pre);
    authors and dates in the order in which they count. Texts and lists are not cut.
    """
    kept = {f"__{c}": c for c in keep}
    columns = ["key", *T.StructType.fromDDL(FACTS).names, *kept]
    src = df.select(F.col(key).cast("string").alias("key"), F.col(html).alias("html"), (F.col(url) if url else F.lit("")).alias("url"), *(F.col(c).cast("string").alias(n) for n, c in kept.items()))
    facts = src.mapInPandas(lambda frames: fact_frames(frames, columns), ", ".join([f"key string, {FACTS}", *(f"{n} string" for n in kept)]))
    return facts.withColumnsRenamed({"key": key, **kept})


# Sites whose word counts as a source.
AUTHORITIES = tuple(
    "wikipedia.org developers.google.com support.google.com web.dev developer.mozilla.org w3.org schema.org ietf.org rfc-editor.org arxiv.org doi.org nature.com science.org sciencedirect.com springer.com acm.org ieee.org "
    "ncbi.nlm.nih.gov who.int oecd.org worldbank.org imf.org pewresearch.org reuters.com apnews.com bbc.com bbc.co.uk nytimes.com theguardian.com ft.com wsj.com economist.com".split()
)
NO_NAME = ("admin", "administrator", "author", "authors", "guest", "unknown", "anonymous", "user", "webmaster", "editor", "staff", "team")
BY_TEXT = r"(?:^|[^\p{L}\p{N}])[Bb]y\s+(\p{Lu}[\p{L}'’.-]*(?:\s+(?:\p{Lu}[\p{L}'’.-]*|de|da|del|der|di|du|la|le|van|von|bin|al)){1,3})"
STAMP = r"(?i)^(?:published|updated|posted|last|by |written|reviewed|\d+ min)|^[\p{L}]{3,9}\.? \d{1,2},? \d{4}$|^\d{4}-\d{2}-\d{2}$"


def is_authoritative(url: Column) -> Column:
    """An address of a government, school, research or reference site."""
    host = E.url_host(url)
    return F.coalesce(host.rlike(r"\.(?:gov|edu|mil|int)$|\.(?:gov|edu|mil|ac|gob|gouv|govt)\.[a-z]{2}$|(?:^|\.)pubmed\.") | E.within(host, AUTHORITIES), F.lit(False))


def iso_date(text: Column) -> Column:
    """The day in a text that begins with year, month and day in any of three forms, or in an English date; null for impossible days and years before 1990 or after 2099."""
    t = F.trim(text)
    digits = F.concat_ws("-", *(F.regexp_extract(t, r"^(\d{4})[-/]?(\d{1,2})[-/]?(\d{1,2})(?!\d)", g) for g in (1, 2, 3)))
    day = F.coalesce(F.try_to_date(digits, "yyyy-M-d"), F.try_to_date(F.regexp_extract(t, r"(?i)(\d{1,2} [a-z]{3})[a-z]* \d{4}", 0), "d MMM yyyy"), F.try_to_date(F.regexp_replace(F.regexp_extract(t, r"(?i)^([a-z]{3})[a-z]*\.? \d{1,2},? \d{4}", 0), r"(?i)^([a-z]{3})[a-z]*\.? (\d{1,2}),? (\d{4})", "$1 $2 $3"), "MMM d yyyy"))
    return F.when((F.length(t) <= 64) & F.year(day).between(1990, 2099), day)


def author_name(raw: Column) -> Column:
    """A name out of a by-line: what stands before a separator or date, six words at most, capitalised, no address and no role; else null."""
    s = F.regexp_replace(X.collapsed(X.plain_marks(raw)), r"(?i)^[^\p{L}]*(?:(?:written|posted|published|reviewed|edited|authored)\s+)?(?:by\s*:?\s+|authors?\s*:\s*|writer\s*:\s*|byline\s*:\s*)?(?:the\s+)?", "")
    s = F.get(F.split(s, r"\s*(?:[|·•,;(\[\]<>]|\s[-–—]\s|—|–)\s*"), F.lit(0))
    s = F.trim(F.regexp_replace(F.regexp_replace(s, r"(?i)\s+(?:on|updated|published|posted|last|in)\b.*$", ""), r"[\s.:-]+$", ""))
    words = F.split(s, " ")
    small = F.exists(words, lambda w: w.rlike(r"^\p{Ll}") & ~F.lower(w).isin("de", "da", "del", "della", "der", "di", "du", "la", "le", "van", "von", "bin", "al", "y", "and", "of", "team", "staff", "editors", "editorial", "desk", "newsroom", "writers", "contributors"))
    return F.when((s != "") & (F.length(s) <= 60) & ~s.rlike(r"https?:|www\.|@|\d") & (F.size(words) <= 6) & ~small & ~F.lower(s).isin(*NO_NAME), s)


def first_of(values: Column, pick) -> Column:
    """The first of an array's values that pick makes something of."""
    return F.get(F.filter(F.transform(values, pick), lambda x: x.isNotNull()), F.lit(0))


def page_signals(facts: DataFrame, key: str, url: Column) -> DataFrame:
    """key and the signals of each page's facts: words, prose, readability, markers, data points, years, dates, names, kinds and types.

    All are column expressions over parse_pages' columns. Prose is paragraphs of four words and more and list items; reading
    ease is for English alone, by the declared language or else by the text.
    """
    blocks = F.coalesce("blocks", F.array().cast("array<struct<kind:string,text:string>>"))
    para = lambda b: (b["kind"] == "p") & (F.regexp_count(b["text"], F.lit(E.WORD)) >= 4)
    texts = lambda cond: F.transform(F.filter(blocks, cond), lambda b: b["text"])
    main = X.plain_marks(F.col("main_text"))
    types = F.transform(F.coalesce("json_ld_types", F.array().cast("array<string>")), lambda t: F.lower(t))
    lead = lambda b: (para(b) | (b["kind"] == "li")) & ~b["text"].rlike(STAMP)
    f = facts.withColumns({
        "__url": url, "__prose": F.array_join(texts(lambda b: para(b) | (b["kind"] == "li")), "\n"), "__paras": texts(para), "__types": types, "main_words": E.count_words(F.coalesce("main_text", F.lit(""))), "n_words": E.count_words(F.coalesce("text", F.lit(""))),
        "first_paragraph": F.substring(F.coalesce(F.get(texts(lambda b: para(b) & ~b["text"].rlike(STAMP)), F.lit(0)), F.lit("")), 1, 300), "lead_text": F.array_join(F.slice(X.word_tokens(F.array_join(texts(lead), " ")), 1, 150), " "),
        "n_h2": F.size(F.filter("headings", lambda h: h["level"] == 2)), "n_h3": F.size(F.filter("headings", lambda h: h["level"] == 3)),
    })
    prose = F.col("__prose")
    words = F.regexp_extract_all(prose, F.lit(E.WORD), 0)
    english = F.when(F.coalesce("lang", F.lit("")) != "", F.col("lang").rlike("(?i)^en(?:$|[-_])")).otherwise(E.looks_english(prose))
    sentences = F.when(F.size(words) > 0, X.sentence_count(prose)).otherwise(0)
    ease = E.reading_ease(F.size(words), sentences, F.aggregate(words, F.lit(0), lambda t, w: t + E.syllables(w)))
    published, modified = first_of(F.col("published"), iso_date), first_of(F.col("modified"), iso_date)
    by_text = author_name(F.nullif(F.regexp_extract(F.substring("main_text", 1, 400), BY_TEXT, 1), F.lit("")))
    # the words are bound to a variable: within the filter they would be counted again for each link
    late = F.get(F.transform(F.array("main_words"), lambda n: F.size(F.filter("link_positions", lambda p: p >= 0.7 * n))), F.lit(0))
    questions = F.size(F.filter("headings", lambda h: h["level"].isin(2, 3) & X.is_question(h["text"])))
    para_words = F.aggregate(F.transform("__paras", lambda p: F.regexp_count(p, F.lit(E.WORD))), F.lit(0), lambda t, n: t + n)
    keys = F.array_distinct(F.filter(F.transform("links", E.url_key), lambda k: k != F.coalesce(E.url_key(F.col("__url")), F.lit(""))))
    noindex = lambda d: F.coalesce("robots", F.lit("")).rlike(rf"(?i)\b(?:{d}|none)\b")
    script = F.least(F.lit(1.0), F.round(F.col("script_chars") / F.col("html_chars"), 3))
    shell = ((F.col("n_words") < 100) & (F.size(keys) < 3) & (F.coalesce("mount_chars", F.lit(99)) < 50)) | ((script > 0.6) & (F.col("n_words") < 80))
    kind = X.parsed_page_type(F.col("__url"), F.col("__types"), F.col("n_dated"))
    issues = F.array(
        F.when(F.coalesce("title", F.lit("")) == "", "title missing"), F.when(F.length("title") < 30, "title short"), F.when(F.length("title") > 60, "title long"), F.when(F.coalesce("description", F.lit("")) == "", "description missing"), F.when(F.length("description") < 70, "description short"),
        F.when(F.length("description") > 160, "description long"), F.when(F.size("h1s") == 0, "h1 missing"), F.when(F.size("h1s") > 1, "h1 many"), F.when(F.col("n_canonicals") > 1, "canonical many"), F.when(F.col("n_words") < 300, "few words"), F.when(F.size(keys) < 3, "few links"), F.when(F.col("n_missing_alt") > 0, "alt missing"),
    )
    return f.select(
        key, "title", "n_words", "main_words", sentences.alias("n_sentences"), F.size("__paras").alias("n_prose_paragraphs"), F.when(english, ease).alias("flesch"), F.when(sentences > 0, E.round_up_half(F.size(words) / sentences, 1)).otherwise(0.0).alias("sentence_words"),
        F.when(F.size("__paras") > 0, E.round_up_half(para_words / F.size("__paras"), 1)).otherwise(0.0).alias("paragraph_words"), "n_h2", "n_h3", "n_lists", "n_ordered", "n_list_items", "n_tables", X.count_data_points(main).alias("n_numbers"),
        *(X.count_markers(main, k).alias(n) for k, n in (("experience", "n_experience"), ("original_data", "n_original"), ("ai_phrase", "n_ai_phrases"), ("ymyl", "n_ymyl"))), F.size(F.filter("externals", is_authoritative)).alias("n_authoritative"), F.size("externals").alias("n_outbound"),
        *(F.size(F.filter("images", lambda o: o == k)).alias(n) for k, n in (("own", "n_own_images"), ("stock", "n_stock_images"))), (F.col("author_in_schema") | F.col("byline_marked") | by_text.isNotNull()).alias("byline"),
        F.coalesce(first_of(F.col("authors"), author_name), by_text).alias("author_name"), "author_in_schema", published.alias("date_published"), modified.alias("date_modified"), X.title_year(F.col("title")).alias("title_year"), "lead_text", "first_paragraph",
        (F.col("has_faq_type") | F.exists("headings", lambda h: h["text"].rlike(r"(?i)\b(?:faqs?|frequently asked)\b"))).alias("has_faq"), late.alias("n_next_steps"), X.clickbait_hits(F.col("title")).alias("n_clickbait"),
        X.title_number(F.col("title")).alias("title_number"), "org_name", F.try_element_at("og", F.lit("site_name")).alias("site_name"), X.title_brand(F.col("title")).alias("title_brand"), F.col("n_same_as"), "n_interstitials", F.array_compact(F.array(F.when(F.col("has_email"), "email"), F.when(F.col("has_phone"), "phone"), F.when(F.col("has_address"), "address"))).alias("contact_details"),
        questions.alias("n_questions"), X.years_in(F.array_join(F.filter(F.col("__paras"), lambda p: ~p.rlike(STAMP)), "\n")).alias("body_years"), kind.alias("page_type"), X.page_format(F.col("title"), kind, X.path_of(F.col("__url")) == "/", F.col("__types"), F.col("n_h2"), F.col("n_tables"), F.col("n_list_items"), F.col("n_ordered"), F.col("first_paragraph"), F.substring("main_text", 1, 400)).alias("format"),
        script.alias("script_share"), F.round(F.length("text") / F.col("html_chars"), 3).alias("text_share"), F.coalesce(shell, F.lit(False)).alias("js_shell"), noindex("noindex").alias("noindex"), noindex("nofollow").alias("nofollow"), F.size(keys).alias("n_unique_links"), F.col("n_internal").alias("n_links"), F.greatest(modified, published).alias("last_modified"), F.array_compact(issues).alias("issues"),
    )
