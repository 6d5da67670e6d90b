"""Main text of web pages by a recurrent labeller of blocks.

A page is cut into leaf blocks: stretches of text between tags that begin or end a
block, each with a hashed vector of its open tags and their names. A bidirectional LSTM in numpy reads the
page's sequence of blocks, each as its tag-path vector and the mean of learned vectors of all its
words (found by hash), and says for every
block whether it belongs to the article, so that blocks are judged in the light of the
whole page. Blocks that it takes are joined in page order.

The network is trained here, on pages that a small generator makes from page
skeletons with known labels: articles in several wrappings among menus, headers,
footers, sidebars, notices, adverts, forms and comments, with unclosed
and missing tags; in made-up words, and with the words that such parts of a page use, which tell
them apart where their tags don't. Its weights depend on fixed seeds only. Scripts, styles and the head
are no blocks.

Defined results: a null or empty page, or one without an article, has empty text and
n_chars 0; null urls stay null; repeated rows give equal rows; an empty table gives an
empty table; further columns, whatever their names, are ignored. Whole pages are
read, and all words of a block; nothing is cut off or capped. Very long pages are labelled as one
sequence; work grows with a page's length, however deep its tags are nested.
"""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import grouped, small_batches

TAGS, WORDS, EXTRA = 512, 8, 9
WIDTH = TAGS + WORDS + EXTRA
BUCKETS = 1 << 16  # of hashed words, each with a learned vector
HIDDEN = 16
BEGIN = re.compile(r"<(?:(/?)([a-zA-Z][\w:-]*)|[!?])")
#: The rest of a tag, in which a mark within quotes ends nothing.
REST = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
#: Elements whose content is no text, and where such content ends.
RAW = {name: re.compile(rf"</{name}\s*>|(?=<body\b)", re.I) for name in ("script", "style", "noscript", "template", "svg", "head", "title")}
NAMED = re.compile(r"""\b(class|id|role|hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
SPACE = re.compile(r"\s+")
EDGES = ".,;:!?…'\"()[]{}<>|*#%&$-–—«»„“”"
#: Elements that stand within a line of text.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that end an open paragraph.
BREAKS = frozenset("address article aside blockquote center details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())


@lru_cache(maxsize=20_000)
def places(label: str) -> tuple[int, ...]:
    """Hashed places of an element's name and the words of its class, id and role."""
    parts = re.findall(r"[a-z0-9]+", label)
    return tuple(zlib.crc32((part if i == 0 else f".{part}").encode()) % TAGS for i, part in enumerate(parts))


@lru_cache(maxsize=20_000)
def inner(label: str) -> tuple[int, ...]:
    """Places that the innermost element counts in as well."""
    return tuple(zlib.crc32(f"^{x}".encode()) % TAGS for x in places(label))


@lru_cache(maxsize=20_000)
def nearest(label: str) -> tuple[int, ...]:
    """Places of the nearest names: of their words, and of each one's last word by itself, since "post-comments" is no post."""
    out = []
    for name in label.split()[1:]:
        words = re.findall(r"[a-z0-9]+", name)
        out += [*words[:-1], *(f"{w}$" for w in words[-1:])]
    return tuple(zlib.crc32(f"@{x}".encode()) % TAGS for x in dict.fromkeys(out))


def markup(page: str) -> Iterator[tuple[int, int, str, str, str]]:
    """Begin and end of all that is no text, and of tags: "/" if it closes, the name in lower case, and the attributes.

    Every character is read a bounded number of times, whatever is left unclosed: what opens after the last ">" opens nothing, and
    after one tag whose quotes never close, quotes count no more.
    """
    at, last, quotes = 0, page.rfind(">"), True
    while (i := page.find("<", at)) >= 0:
        at = i + 1
        if page.startswith("<!--", i):
            j = page.find("-->", i + 4)
            at = len(page) if j < 0 else j + 3
            yield i, at, "", "", ""
            continue
        if i > last:
            at = page.find("<!--", at)
            if at < 0:
                return
            continue
        m = BEGIN.match(page, i)
        if not m:
            continue
        name = (m[2] or "").lower()
        raw = next((r for r in RAW if name == r or name.startswith((f"{r}-", f"{r}:"))), "") if not m[1] else ""
        if raw or not name:
            at = page.find(">", i) + 1
            if raw:
                end = RAW[raw].search(page, at)
                at = end.end() if end else len(page)
            yield i, at, "", "", ""
            continue
        rest = REST.match(page, m.end()) if quotes else None
        quotes = rest is not None
        at = rest.end() if rest else page.find(">", m.end()) + 1
        yield i, at, m[1], name, page[m.end() : at - 1]


class Block:
    """A leaf block: its text, characters within links, vector of open elements, and their number."""

    __slots__ = ("text", "links", "tags", "depth")

    def __init__(self, text: str, links: int, tags: np.ndarray, depth: int):
        self.text, self.links, self.tags, self.depth = text, links, tags, depth


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page, in order."""
    out: list[Block] = []
    path: list[tuple[str, str]] = []
    named: list[str] = []  # labels of the open elements that have a name
    open_: Counter = Counter()
    tags = np.zeros(TAGS, np.int32)  # how many open elements fall in each place
    text: list[str] = []
    links = at = 0

    def end() -> None:
        nonlocal links
        if text:
            t = SPACE.sub(" ", html.unescape("".join(text))).strip()
            if t:
                v = np.minimum(tags, 2).astype(np.float32)
                last = next((label for _, label in reversed(path[-2:]) if label), "")
                for k in (*inner(last), *(nearest(named[-1]) if named else ())):
                    v[k] = min(2.0, v[k] + 1)
                out.append(Block(t, links, v, len(path)))
            text.clear()
        links = 0

    def push(tag: str, label: str) -> None:
        path.append((tag, label))
        open_[tag] += 1
        if " " in label:
            named.append(label)
        for k in places(label):
            tags[k] += 1

    def pop() -> str:
        tag, label = path.pop()
        open_[tag] -= 1
        if " " in label:
            named.pop()
        for k in places(label):
            tags[k] -= 1
        return tag

    for begin, stop, closes, tag, attributes in markup(page):
        if begin > at:
            text.append(page[at:begin])
            if path and path[-1][0] == "a":
                links += begin - at
        at = stop
        if not tag:
            continue
        if tag in INLINE:
            if tag == "br":
                text.append(" ")
            elif tag == "a":
                if closes:
                    if path and path[-1][0] == "a":
                        pop()
                elif not path or path[-1][0] != "a":
                    push("a", "")
            continue
        end()
        if path and path[-1][0] == "a":
            pop()
        if closes:
            while open_[tag] and pop() != tag:
                pass
        elif tag not in VOID:
            if tag in BREAKS and path and path[-1][0] == "p" or tag == "li" and path and path[-1][0] == "li":
                pop()
            names = " ".join(x[1] or x[2] or x[3] or x[0] for x in NAMED.findall(attributes)) if attributes else ""
            push(tag, f"{tag} {names.lower()}" if names else tag)
    if at < len(page):
        text.append(page[at:])
    end()
    return out


def words_of(text: str) -> list[int]:
    """Buckets of all different words of a block, in lower case, without the marks around them unless they are nothing else."""
    return sorted({zlib.crc32((w.strip(EDGES) or w).encode("utf-8", "surrogatepass")) % BUCKETS for w in set(text.lower().split(" "))})


def vectors(rows: list[Block]) -> tuple[np.ndarray, list[list[int]]]:
    """Rows of features, with zeros where the words' mean vector goes, and the buckets of each block's words."""
    out = np.zeros((len(rows), WIDTH), np.float32)
    buckets = [words_of(r.text) for r in rows]
    n = max(1, len(rows))
    for i, (r, words) in enumerate(zip(rows, buckets, strict=True)):
        out[i, :TAGS] = r.tags
        t = r.text
        out[i, -EXTRA:] = [min(1.0, np.log1p(t.count(" ") + 1) / 6), min(1.0, r.links / len(t)), t[-1] in ".!?…", "©" in t or "(c)" in t[:40].lower(), i / n, 1.0, min(2.0, r.depth / 10), i == 0, i == n - 1]
    return out, buckets


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Lstm:
    """Both directions over padded sequences, then one output for each block."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        init = lambda *shape: rng.normal(0, shape[0] ** -0.5, shape).astype(np.float32)
        self.p = {f"{k}{d}": v for d in "fb" for k, v in (("w", init(WIDTH, 4 * HIDDEN)), ("u", init(HIDDEN, 4 * HIDDEN)), ("c", np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)]).astype(np.float32)))}
        self.p |= {"o": init(2 * HIDDEN, 1)[:, 0], "d": init(WIDTH, 1)[:, 0] * 0.1, "e": np.zeros(1, np.float32), "v": np.zeros((BUCKETS, WORDS), np.float32)}

    def filled(self, x: np.ndarray, buckets: list[list[int]]) -> np.ndarray:
        """Rows of features with the mean vectors of their words, each word weighing by the root of their number."""
        length = np.fromiter(map(len, buckets), np.int64, len(buckets))
        if len(buckets):
            flat = np.fromiter((b for r in buckets for b in r), np.int64, int(length.sum()))
            x[:, TAGS : TAGS + WORDS] = np.add.reduceat(self.p["v"][flat], np.cumsum(length) - length, axis=0) / np.sqrt(length)[:, None]
        return x

    def _scan(self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool):
        n, t, _ = x.shape
        pre = x @ self.p["w" + d] + self.p["c" + d]
        h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        out, tape = np.zeros((n, t, HIDDEN), np.float32), []
        for k in range(t) if d == "f" else range(t - 1, -1, -1):
            z = pre[:, k] + h @ self.p["u" + d]
            i, f, o = np.split(_sigmoid(z[:, : 3 * HIDDEN]), 3, axis=1)
            g = np.tanh(z[:, 3 * HIDDEN :])
            new = f * c + i * g
            m = mask[:, k, None]
            tanh = np.tanh(new)
            if keep:
                tape.append((k, h, c, i, f, o, g, tanh))
            h = np.where(m, o * tanh, h)
            c = np.where(m, new, c)
            out[:, k] = h
        return out, tape

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        a, ta = self._scan(x, mask, "f", keep)
        b, tb = self._scan(x, mask, "b", keep)
        both = np.concatenate([a, b], axis=2)
        return both @ self.p["o"] + x @ self.p["d"] + self.p["e"], both, ta, tb

    def grads(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Gradient of the mean logistic loss over blocks, back through time."""
        logit, both, ta, tb = self.forward(x, mask, True)
        dl = (_sigmoid(logit) - y) * mask / mask.sum()
        g = {"o": (both * dl[..., None]).sum((0, 1)), "d": (x * dl[..., None]).sum((0, 1)), "e": np.array([dl.sum()])}
        part_x = slice(TAGS, TAGS + WORDS)
        gx = dl[..., None] * self.p["d"][part_x]
        for d, tape, part in (("f", ta, slice(0, HIDDEN)), ("b", tb, slice(HIDDEN, None))):
            dh, dc = np.zeros((len(x), HIDDEN)), np.zeros((len(x), HIDDEN))
            gw, gu, gc = (np.zeros(self.p[k + d].shape) for k in "wuc")
            for k, h, c, i, f, o, gate, tanh in reversed(tape):
                m = mask[:, k, None]
                dh = dh + dl[:, k, None] * self.p["o"][part]
                da = np.where(m, dh, 0)
                dn = np.where(m, dc, 0) + da * o * (1 - tanh**2)
                dz = np.concatenate([dn * gate * i * (1 - i), dn * c * f * (1 - f), da * tanh * o * (1 - o), dn * i * (1 - gate**2)], axis=1)
                gw += x[:, k].T @ dz
                gx[:, k] += dz @ self.p["w" + d][part_x].T
                gu += h.T @ dz
                gc += dz.sum(axis=0)
                dh = np.where(m, 0, dh) + dz @ self.p["u" + d].T
                dc = np.where(m, dn * f, dc)
            g |= {"w" + d: gw, "u" + d: gu, "c" + d: gc}
        return g | {"x": gx}  # by the mean vectors of words


def padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    t = max(map(len, rows))
    x, mask = np.zeros((len(rows), t, WIDTH), np.float32), np.zeros((len(rows), t), bool)
    for i, r in enumerate(rows):
        x[i, : len(r)] = r
        mask[i, : len(r)] = True
    return x, mask


#: Words that the parts of a page around its article use, by part, and names that such parts go by.
CUES = {
    "cookie": "cookies cookie consent accept reject all manage preferences settings privacy policy we use to improve your experience by continuing agree gdpr datenschutz akzeptieren zustimmen wir verwenden utilisons accepter confidentialité utilizamos aceptar privacidad notice important announcement maintenance update browser javascript enable hinweis avis aviso",
    "ad": "advertisement advert ad ads sponsored sponsor promoted offer offers buy now shop save sale discount deal deals limited free shipping order today click here best price coupon anzeige werbung angebot jetzt kaufen publicité offre acheter publicidad oferta comprar",
    "comments": "comment comments reply replies report like likes dislike upvote commented says said wrote reader readers posted by ago login to responses discussion thread user guest anonymous kommentar kommentare antworten melden schrieb commentaire commentaires répondre signaler comentario comentarios responder",
    "footer": "copyright (c) © all rights reserved terms of use service privacy contact about us imprint sitemap company inc ltd impressum kontakt alle rechte vorbehalten agb mentions légales tous droits réservés contact aviso legal todos los derechos reservados powered by",
    "form": "email e-mail address name password subscribe subscription sign up in log login register submit search send message newsletter your enter required field phone anmelden abonnieren suche senden s'abonner rechercher envoyer suscribirse buscar enviar",
    "related": "related articles read more also see trending recommended popular latest next previous stories you may might like most viewed mehr lesen ähnliche artikel lire aussi articles similaires leer más relacionados",
    "share": "share tweet facebook twitter linkedin whatsapp print pin follow us on tags tagged filed under by author published updated min read teilen folgen partager suivre compartir seguir views",
    "nav": "home news sports about contact blog archive categories products services login menu help faq store english deutsch français español skip to content start startseite accueil inicio",
}
#: Words that stand in any text.
COMMON = frozenset("the and of to in for is on that with as are was this from at by an be or not it we you your all us up under no if our my a i o s der die und das zu mit von ist ein auf wir alle im den dem eine nicht für le la les des et une du que est dans pour un au nous tous en el los las y por con una se del su es lo al como todos".split())
NAMES = {
    "nav": "menu nav navbar navigation topnav breadcrumb breadcrumbs main-menu site-nav toolbar links pagination pager toc tabs",
    "ad": "ad ads advert advertisement banner sponsored promo promotion ad-slot adsense ad-container sponsor commercial dfp outbrain taboola",
    "cookie": "cookie cookie-banner consent notice gdpr popup overlay modal alert announcement cc-window privacy-bar toast message-bar disclaimer",
    "form": "form search searchform signup subscribe newsletter login contact-form mailing-list optin register poll survey",
    "comments": "comments comment comment-list commentlist discussion replies responses reply feedback disqus thread reactions respond user-comments talkback livefyre fb-comments guestbook reviews",
    "related": "related recommended more trending read-next also-like popular suggestions related-posts more-stories most-read next-up carousel teasers",
    "share": "share social tags meta byline author-box sharing social-links post-meta entry-meta follow likes toolbox",
    "footer": "footer site-footer bottom copyright colophon page-footer legal imprint footer-links credits",
    "side": "sidebar side aside widget widgets secondary right-column rail side-bar left-col",
    "header": "header site-header masthead top-bar topbar branding logo page-header hero-bar",
    "article": "content post article story entry-content main-content article-body post-content story-body body-text entry text page-content news-article blog-post",
}


class Skeletons:
    """Pages with known labels. Each piece of text is (html, belongs to the article)."""

    def __init__(self, seed: int = 11, names: dict[str, str] | None = None):
        self.rng = np.random.default_rng(seed)
        self.names = {k: v.split() for k, v in (names or NAMES).items()}
        self.cues = {k: [w for w in v.split() if w not in COMMON] for k, v in CUES.items()}
        self.common = sorted(COMMON)
        self.stems = "post article entry page site story blog news content main".split()

    def pick(self, items):
        return items[self.rng.integers(len(items))]

    def made_up(self, n: int) -> list[str]:
        letters = "etaoinshrdlucmé"
        often = self.pick([0, 0.2, 0.4])
        return [self.pick(self.common) if self.rng.random() < often else "".join(self.pick(letters) for _ in range(self.rng.integers(1, 11))) for _ in range(n)]

    def words(self, lo: int, hi: int) -> str:
        ws = self.made_up(int(self.rng.integers(lo, hi + 1)))
        if self.rng.random() < 0.1:  # an article may speak of such things too
            ws[int(self.rng.integers(len(ws)))] = self.pick(self.cues[self.pick(list(self.cues))])
        marks = self.pick(["", "", "", "!!", "***", "###", " |"])
        return (marks + " ").join(ws).capitalize() + self.pick([".", ".", ".", "", "!", "?"])

    def said(self, kind: str, lo: int, hi: int, share: float = 0.5) -> str:
        """Words of a part of the page that isn't the article; those that it uses among made-up ones."""
        n = int(self.rng.integers(lo, hi + 1))
        made, cues = self.made_up(n), self.cues[kind]
        ws = [self.pick(cues) if self.rng.random() < share else w for w in made]
        if share >= 0.6:  # where words alone tell, some do
            ws[: max(1, n // 3)] = [self.pick(cues) for _ in range(max(1, n // 3))]
            ws = [ws[i] for i in self.rng.permutation(n)]
        return " ".join(ws).capitalize() + self.pick([".", ".", "", "", "!"])

    def wrap(self, kind: str, plain: float) -> tuple[str, str]:
        """Tags around a part: one with a telling name, or with that chance a plain one."""
        if self.rng.random() < plain:
            return self.pick([("<div>", "</div>"), ("<section>", "</section>"), ("", "")])
        tag = self.pick(["div", "div", "div", "section", "ul" if kind == "nav" else "div"])
        name = self.pick(self.names[kind])
        if self.rng.random() < 0.4:  # named after the article that it belongs to
            name = self.pick([f"{self.pick(self.names['article'])}-{name}", f"{self.pick(self.stems)}-{name}", f"{self.pick(self.stems)}_{name}"])
        more = self.pick(["", "", "", f" {self.pick(self.names[kind])}", " clearfix", " row", " col-4"])
        return f'<{tag} {self.pick(["class", "class", "id"])}="{name}{more}">', f"</{tag}>"

    def links(self) -> list[tuple[str, int]]:
        n = int(self.rng.integers(2, 9))
        items = [f'<a href="/x">{self.said("nav", 1, 2, 0.3).rstrip(".")}</a>' for _ in range(n)]
        if self.rng.random() < 0.7:
            return [("<ul>", -1), *((f"<li>{i}</li>", 0) for i in items), ("</ul>", -1)]
        return [(" ".join(items), 0)]

    def around(self, inside: bool = False) -> list[tuple[str, int]]:
        """One stretch that isn't the article; inside the article's element it has an element of its own."""
        kind = self.pick(["nav", "ad", "ad", "side", "cookie", "form", "comments", "comments", "header", "related", "share", "footer"])
        plain = self.rng.random() < 0.3  # no tag or name tells; then the words do
        share = 0.6 if plain else self.pick([0.0, 0.0, 0.2, 0.5])
        # What is said of nothing in particular has a name.
        text = lambda lo, hi, k=kind: self.said(k if k in self.cues else "related", lo, hi, share)
        o, c = self.wrap(kind, 1.0 if plain else 0.0)
        if inside and not o:
            o, c = "<div>", "</div>"
        block = lambda lo, hi: self.pick([f"<p>{text(lo, hi)}</p>", f"<p>{text(lo, hi)}</p>", f"<div>{text(lo, hi)}</div>", f"<span>{text(lo, hi)}</span><p></p>"])
        if kind == "nav":
            o, c = self.pick([("<nav>", "</nav>"), ('<div role="navigation">', "</div>"), self.wrap("nav", 0.0), self.wrap("nav", 0.0)])
            return [(o, -1), *self.links(), (c, -1)]
        if kind == "ad":
            return [(o, -1), (block(3, 25) if o == "" or self.rng.random() < 0.4 else text(3, 40), 0), ("<p></p>" if o == "" else "", -1), (c, -1)]
        if kind == "side":
            o, c = self.pick([("<aside>", "</aside>"), self.wrap("side", 0.0)])
            return [(o, -1), (f"<h3>{self.words(1, 4)}</h3>", 0), *(self.links() if self.rng.random() < 0.5 else [(f"<p>{self.words(3, 30)}</p>", 0) for _ in range(2)]), (c, -1)]
        if kind == "cookie":
            return [(o, -1), (block(4, 25), 0), (f"<button>{text(1, 2)}</button>" if o else f"<p>{text(2, 3)}</p>", 0), (c, -1)]
        if kind == "form":
            if self.rng.random() < 0.6:
                o, c = "<form>", "</form>"
            return [(o, -1), (f"<p>{text(2, 9)}</p>", 0), *([(f"<label>{text(1, 3)}</label><p></p>", 0)] if o == "<form>" else []), (f"<div>{text(1, 2)}</div>", 0), (c, -1)]
        if kind == "comments":
            n = int(self.rng.integers(1, 6))
            if not plain and self.rng.random() < 0.3:
                o, c = re.sub("^<[a-z]+", "<" + (tag := self.pick(["ol", "ul"])), o), f"</{tag}>"
                return [(o, -1), *((f"<li>{text(3, 30)}</li>", 0) for _ in range(n)), (c, -1)]
            head = [(f"<h3>{text(1, 4)}</h3>", 0)] if plain or self.rng.random() < 0.5 else []
            return [(o, -1), *head, *((block(3, 30), 0) for _ in range(n)), (c, -1)]
        if kind == "related":
            head = [(f"<h3>{text(2, 4)}</h3>", 0)] if plain or self.rng.random() < 0.5 else []
            return [(o, -1), *head, *self.links(), ("<p></p>", -1), (c, -1)]
        if kind == "footer":
            return [(o, -1), (f"<p>{self.pick(['&copy; ', '(c) 2020 ', '(c) ', 'Copyright 2021 ', ''])}{self.said('footer', 2, 12, 0.6 if plain else share)}</p>", 0), (c, -1)]
        if kind == "share":
            return [(o, -1), (f"<p>{text(2, 7)}</p>" if plain else f"<div>{text(1, 6)}</div>", 0), (c, -1)]
        o, c = self.pick([("<header>", "</header>"), self.wrap("header", 0.0)])
        return [(o, -1), (f"<h2>{self.words(1, 4)}</h2>", 0), (self.words(2, 8), 0), (c, -1)]

    def article(self) -> list[tuple[str, int]]:
        named = self.pick(self.names["article"])
        wrap = self.pick([("<article>", "</article>")] * 4 + [("<main>", "</main>"), (f'<div class="{named}">', "</div>"), (f'<div class="{named}">', "</div>"), (f'<div id="{named}">', "</div>"), (f'<section class="{named}">', "</section>"), ("<main><article>", "</article></main>"), ('<div role="main">', "</div>"), ("<div>", "</div>")])
        out = [(wrap[0], -1)]
        head = self.words(2, 14)
        if self.rng.random() < 0.85:
            out.append((f"<h1>{head}</h1>", 1))
        for k in range(int(self.rng.choice([1, 2, 3, 4, 6, 9, 14, 25], p=[0.2, 0.15, 0.15, 0.15, 0.15, 0.1, 0.05, 0.05]))):
            x = self.rng.random()
            text = head if k == 0 and x < 0.3 else self.words(1, 60)
            if x < 0.2:
                out.append((f"<p><b>{text}<br>", 1))
            elif x < 0.75:
                out.append((f"<p>{text}</p>", 1))
            elif x < 0.82:
                out.append((f"<h2>{self.words(1, 8)}</h2>", 1))
            elif x < 0.87:
                out.append((f"<ul><li>{self.words(1, 12)}</li></ul>", 1))
            elif x < 0.91:
                out.append((f"<blockquote>{text}</blockquote>", 1))
            elif x < 0.93:
                out.append((f"<pre>{text}</pre>", 1))
            elif x < 0.95:
                out += [("<table><tr>", -1), (f"<td>{self.words(1, 4)}</td>", 1), (f"<td>{self.words(1, 4)}</td>", 1), ("</tr></table>", -1)]
            else:
                out += [("</p>", -1), *self.around(True)]
        if self.rng.random() < 0.5:  # what stands below an article within its element
            out += [("</p>", -1), *self.around(True)]
        return [*out, (wrap[1], -1)]

    def page(self) -> tuple[str, list[int]]:
        parts: list[tuple[str, int]] = []
        for _ in range(int(self.rng.integers(0, 4))):
            parts += self.around()
        if self.rng.random() < 0.93:
            parts += self.article()
        for _ in range(int(self.rng.integers(0, 4))):
            parts += self.around()
        if self.rng.random() < 0.8:
            o, c = self.pick([("<footer>", "</footer>")] * 3 + [self.wrap("footer", 0.0), ('<p class="copyright">', "</p>"), ("<p>&copy; ", "</p>"), ("<p>(c) 2020 ", "</p>")])
            parts += [(o, -1), (self.pick(["&copy; ", "", ""]) + self.said("footer", 2, 14, self.pick([0.0, 0.3, 0.6])), 0), (c, -1)]
        tail = self.pick(["</body></html>", "</body></html>", ""])
        page = "<!DOCTYPE html><html><head><title>t</title></head><body>" + "".join(h for h, _ in parts) + tail
        return page, [y for _, y in parts if y >= 0]


@lru_cache(maxsize=1)
def trained(pages: int = 3600, epochs: int = 14) -> Lstm:
    """The labeller, fitted to generated pages; the same weights each time."""
    maker, data = Skeletons(), []
    while len(data) < pages:
        page, y = maker.page()
        rows = blocks(page)
        if rows and len(rows) == len(y):  # texts that flow together have no label of their own
            data.append((*vectors(rows), np.array(y, np.float32)))
    net = Lstm()
    rng = np.random.default_rng(5)
    m, v = ({k: np.zeros_like(p, dtype=np.float64) for k, p in net.p.items()} for _ in range(2))
    step = 0
    for epoch in range(epochs):
        rate = 0.01 if epoch < epochs - 4 else 0.001  # small steps at last
        order = sorted(range(len(data)), key=lambda i: (len(data[i][0]) + rng.integers(0, 6)))
        groups = [order[i : i + 32] for i in range(0, len(order), 32)]
        for g in rng.permutation(len(groups)):
            some = groups[g]
            x, mask = padded([net.filled(data[i][0], data[i][1]) for i in some])
            y = np.zeros(mask.shape, np.float32)
            for r, i in enumerate(some):
                y[r, : len(data[i][2])] = data[i][2]
            step += 1
            grads = net.grads(x, mask, y)
            by_row = grads.pop("x")[mask]
            words = [b for i in some for b in data[i][1]]
            length = np.fromiter(map(len, words), np.int64, len(words))
            by_row = by_row / np.sqrt(length)[:, None]
            grads["v"] = np.zeros((BUCKETS, WORDS))
            np.add.at(grads["v"], np.concatenate([np.array(b) for b in words]), np.repeat(by_row, length, axis=0))
            grads["v"] += 1e-5 * net.p["v"]
            for k, grad in grads.items():
                m[k] = 0.9 * m[k] + 0.1 * grad
                v[k] = 0.999 * v[k] + 0.001 * grad**2
                net.p[k] = (net.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def main_texts(net: Lstm, pages: list[str]) -> list[str]:
    rows = [blocks(p) for p in pages]
    out = [""] * len(pages)
    order = sorted((i for i in range(len(pages)) if rows[i]), key=lambda i: len(rows[i]))
    lo = 0
    while lo < len(order):
        # Sequences of like length together, and fewer of them where they are long.
        hi = lo + 1
        while hi < len(order) and (hi - lo + 1) * len(rows[order[hi]]) <= 16_384 and len(rows[order[hi]]) <= 2 * len(rows[order[lo]]) + 8:
            hi += 1
        part = order[lo:hi]
        x, mask = padded([net.filled(*vectors(rows[i])) for i in part])
        good = net.forward(x, mask)[0] > 0
        for r, i in enumerate(part):
            out[i] = "\n\n".join(b.text for b, y in zip(rows[i], good[r], strict=False) if y)
        lo = hi
    return out


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars."""
    small_batches(pages.sparkSession)
    net = trained()

    def run(batches):
        for table in grouped(batches, 4 << 20):
            texts = main_texts(net, [h or "" for h in table["html"].to_pylist()])
            yield pa.RecordBatch.from_arrays([table["page_id"].combine_chunks(), table["url"].combine_chunks(), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
