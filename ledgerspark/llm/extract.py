"""Main text of HTML pages by a recurrent block labeller.

A page is cut into leaf blocks (text between block-level tags). Each block has a vector of its hashed tag path (tags
with their class, id and role words), one of its hashed words, and a few numbers (length, links, place). A
bidirectional LSTM in numpy reads the blocks of the whole page in order and labels each as main text or not.

It learns from pages that are composed here (articles in many kinds of surroundings, with words of the sample; those of
compose_plain have no names or sectioning elements that give their parts away) and
from at most SAMPLE pages of the input, whose labels come from HTML's own sectioning elements where they have any.

Defined cases: an empty table gives no rows; pages of any length are read whole; a block whose score ties at 0.5 is left out; other
columns do not matter; a line break (br) ends a block, so lines of verse or of an address are blocks of their own; null and
empty html, and pages without main text, give an empty text; markup that is cut off or not
closed is read as browsers do, roughly: a new paragraph ends an open one. Only script, style, title and textarea run on
to their end tag or the end of input. What stands in other UNSHOWN elements is left out if they are closed by their own end
tag; if the end tag is missing, they end with the element around them, and their blocks are labelled like any other. A
button's own words are left out, blocks inside it are labelled; an option ends at the next one or at any block. Repeated rows are extracted each.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table

SAMPLE, COMPOSED, PLAIN, EPOCHS, BATCH, RATE, SEED = 300, 2500, 1500, 8, 48, 0.015, 5
PATHS, WORDS, EMBED, HIDDEN, NUMBERS = 1 << 12, 1 << 12, 12, 12, 6
#: Sample pages of more blocks than this are not learned from (a bound on the memory of a step); they are labelled like any other.
LONGEST_SAMPLE = 1024
#: Pages labelled together.
TOGETHER = 256

#: HTML's elements by kind, fixed values.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea".split())
UNSHOWN = frozenset("noscript template iframe svg select option button".split())
BLOCK = frozenset(
    "address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES = {"li": ("ul", "ol", "menu"), "dd": ("dl",), "dt": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table")}
MAIN, ASIDE = {"article", "main"}, {"nav", "aside", "footer", "header", "form"}

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][\w:-]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)>|<[!?/][^>]*>|<[a-zA-Z/!?][^<]*\Z|([^<]+|<)", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
LETTERS = re.compile(r"[A-Za-z]+")


def narrowed(path: tuple[str, ...], own: list[str]) -> tuple[str, ...]:
    """The path with own at its end: each name once, where it comes last; the same tuple if that changes nothing."""
    if path[-len(own) :] == tuple(own):
        return path
    new = list(dict.fromkeys(reversed(own)))[::-1]
    return (*(w for w in path if w not in new), *new)


#: Open elements beyond this number are read as siblings, as browsers do; names of an element that count.
DEEPEST, NAMES = 512, 32


def blocks(page: str | None) -> list[tuple[str, tuple[str, ...], float]]:
    """(text, path, share of its characters in links) of each leaf block, in page order."""
    out, stack, text, linked, total = [], [], [], 0, 0
    path: tuple[str, ...] = ()
    opened: Counter = Counter()  # tags in the stack
    marks = []  # of each UNSHOWN element in the stack: its place there, and what had been read before it

    def flush():
        nonlocal text, linked, total
        if text:
            whole = " ".join(entities.unescape("".join(text)).split())
            if whole:
                out.append((whole, path, linked / max(1, total)))
        text, linked, total = [], 0, 0

    def undo(mark):
        nonlocal text, linked, total, path
        _, blocks_before, text, words_before, linked, total, path = mark
        del out[blocks_before:], text[words_before:]

    def pop_to(k: int, own_end: bool = False):
        """Close all from place k on; own_end: by the end tag of the element at k."""
        while marks and marks[-1][0] >= k:
            mark = marks.pop()
            tag = stack[mark[0]][0]
            if tag == "option" or own_end and mark[0] == k and (tag != "button" or mark[1] == len(out) and mark[2] is text):
                undo(mark)
        opened.subtract(e[0] for e in stack[k:])
        del stack[k:]

    def last(tag: str, least: int = 0) -> int | None:
        return next((k for k in range(len(stack) - 1, least - 1, -1) if stack[k][0] == tag), None) if opened[tag] > 0 else None

    page, at = page or "", 0
    while m := TOKEN.match(page, at):
        at = m.end()
        closing, tag, rest, words = m.groups()
        if words is not None:
            if not text:
                path = stack[-1][1] if stack else ()
            text.append(words)
            total += len(words)
            if opened["a"] > 0:
                linked += len(words)
            continue
        if tag is None:
            continue
        tag = tag.lower()
        if marks and stack[marks[-1][0]][0] == "option" and (tag in BLOCK or not closing and tag in ("option", "optgroup")):
            pop_to(marks[-1][0])
        if tag in BLOCK:
            flush()
        if closing:
            k = last(tag)
            if k is not None and (tag in BLOCK or tag in UNSHOWN or not any(e[0] in BLOCK for e in stack[k + 1 :])):
                if tag == "button" and any(e[0] in BLOCK for e in stack[k + 1 :]):
                    flush()
                pop_to(k, own_end=True)
        elif rest.endswith("/") and opened["svg"] > 0:
            pass  # only there does a slash close an element
        elif tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
        elif tag not in VOID:
            inside = marks[-1][0] + 1 if marks else 0  # what is open around an UNSHOWN element is not closed from within
            if tag in BLOCK and (k := last("p", inside)) is not None:
                pop_to(k)
            if tag == "button" and (k := last("button")) is not None:
                flush()
                pop_to(k)
            if tag in CLOSES:
                for k in range(len(stack) - 1, inside - 1, -1):
                    if stack[k][0] in CLOSES[tag]:
                        break
                    if stack[k][0] == tag:
                        pop_to(k)
                        break
            own = [tag]
            if rest.strip():
                for name, value in ATTRIBUTE.findall(rest):
                    own += [f"{name[:2].lower()}:{x.lower()}" for x in LETTERS.findall(value)[:NAMES]] or [name.lower()]
                del own[NAMES + 1 :]
            if len(stack) >= DEEPEST and tag not in UNSHOWN and not (marks and marks[-1][0] == len(stack) - 1):
                pop_to(len(stack) - 1)
            if tag in UNSHOWN:
                marks.append((len(stack), len(out), text, len(text), linked, total, path))
            stack.append((tag, narrowed(stack[-1][1] if stack else (), own)))
            opened[tag] += 1
        if at >= len(page):
            break
    if marks and stack[marks[-1][0]][0] == "option":
        pop_to(marks[-1][0])
    flush()
    return out


def weak_label(path: tuple[str, ...]) -> int | None:
    """What HTML's sectioning elements say of a block: the innermost one decides; None if there is none."""
    for w in reversed(path):
        if w in MAIN or w in ASIDE:
            return int(w in MAIN)
    return None


class Hashes(dict):
    """Hashed ids of strings, remembered up to a bound."""

    def __init__(self, size: int):
        self.size = size

    def __missing__(self, x: str) -> int:
        if len(self) > 200_000:
            self.clear()
        at = self[x] = zlib.crc32(x.encode()) % self.size
        return at


PATH_IDS, WORD_IDS = Hashes(PATHS), Hashes(WORDS)


#: Names that page templates give to what is not main text, and to what is. Fixed values.
CLUTTER = (
    "nav menu navbar navigation breadcrumb header masthead banner topbar footer bottom copyright sidebar aside rail widget related recommended popular share social "
    "ad ads advert advertisement sponsored promo promotion cookie consent notice alert gdpr popup modal overlay newsletter subscribe signup login search comment comments "
    "reply respond disqus discussion pagination pager toolbar tags meta legal disclaimer form contact feedback"
).split()
CONTENT = "content article post entry story main body text page document prose".split()


#: What pages say outside of their main text, in parts that are put together at random. Fixed values; {} is a name, # a number.
NOTICES = (
    "we use cookies to improve your experience|this site uses cookies|we value your privacy|manage cookie settings|accept all|reject all|by continuing you agree to our privacy policy|read our cookie policy",
    "subscribe to our newsletter|sign up for our weekly newsletter|get the latest news in your inbox|enter your email address|no spam, unsubscribe at any time|join # readers|stay up to date",
    "all rights reserved|copyright # {}|© # {} ltd|© {}|terms of service|privacy policy|terms of use and privacy|imprint|legal notice|powered by {}|made with love in {}|about us|contact us|careers|site map",
    "home|news|sport|about|contact|login|log in|sign in|register|my account|pricing|products|blog|docs|search|menu|help|support|shop|cart (#)|checkout|faq|archive|categories|back to top|back to index|back to overview|skip to content|next|previous|edit this page|on this page|table of contents",
    "save #% on {} today only|buy now|advertisement|sponsored|sponsored content|limited offer: # off|free shipping on all orders|get # months free|order today|click here to learn more|ad by {}|special deal for you|download our app",
    "share this|share on {}|tweet|follow us on {}|like|print|email this|# shares|# comments|posted by {}|leave a reply|leave a comment|reply|report abuse|log in to comment|# minutes ago by {}",
    "related articles|you may also like|recommended for you|most read|popular posts|latest news|trending now|more from {}|read next|editor's picks|see all|read more|tags: {}, {}|filed under {}",
    "wir verwenden cookies|alle akzeptieren|alle rechte vorbehalten|impressum|datenschutz|kontakt|anmelden|startseite|nous utilisons des cookies|tout accepter|tous droits réservés|mentions légales|accueil|connexion|usamos cookies|aceptar todo|todos los derechos reservados|aviso legal|inicio|suscríbete",
)
NOTICES = tuple(tuple(n.split("|")) for n in NOTICES)


def notice(rng: np.random.Generator, words: np.ndarray) -> str:
    """Something that a page says beside its main text."""
    own = NOTICES[rng.integers(len(NOTICES))]
    parts = [str(x) for x in rng.choice(own, min(len(own), int(rng.integers(1, 4))), replace=False)]
    out = [re.sub(r"#|\{\}", lambda m: str(rng.integers(1, 2030)) if m[0] == "#" else str(rng.choice(words)).strip(".,;:!?").capitalize(), x) for x in parts]
    out = [x.capitalize() if rng.random() < 0.7 else x.upper() if rng.random() < 0.1 else x for x in out]
    return str(rng.choice([" ", ". ", " | ", " · ", " - ", ", "])).join(out) + str(rng.choice(["", "", ".", "!", " ..."]))


def compose(rng: np.random.Generator, words: np.ndarray) -> list[tuple[str, tuple[str, ...], float, int]]:
    """A made-up page: blocks with their labels."""
    def say(lo, hi):
        return " ".join(rng.choice(words, rng.integers(lo, hi)))

    def name(pool):
        return [f"{rng.choice(['cl', 'id', 'cl'])}:{rng.choice(pool)}"] + [f"cl:{rng.choice(['box', 'block', 'wrap', 'inner', 'section', 'container', 'col', 'row'])}"] * int(rng.random() < 0.3)

    def clutter(inside):
        kind = rng.integers(6)
        tag = rng.choice(["nav", "aside", "footer", "header", "form"])
        own = [tag] + (name(CLUTTER) if rng.random() < 0.4 else []) if rng.random() < 0.5 else ["div" if rng.random() < 0.8 else "section", *name(CLUTTER)]
        if rng.random() < 0.1:
            own = ["div", "ro:" + str(rng.choice(["navigation", "banner", "complementary", "contentinfo", "search", "alert", "dialog"]))]
        base = (*inside, *own)
        if kind == 0:
            return [(say(1, 4), (*base, "ul", "li", "a"), 1.0, 0) for _ in range(rng.integers(2, 9))]
        if kind == 1:
            return [(say(1, 5), (*base, "h3"), 0.0, 0)] + [(say(4, 40), (*base, "p"), float(rng.random() < 0.2), 0) for _ in range(rng.integers(1, 5))]
        if kind == 2:
            return [(say(2, 20), base, 0.0, 0)]
        if kind == 3:
            return [(say(4, 60), (*base, *(["div", *name(CLUTTER)] if rng.random() < 0.5 else []), "p"), 0.0, 0) for _ in range(rng.integers(1, 7))]
        return [(say(2, 15), base if rng.random() < 0.5 else (*base, "p"), float(rng.choice([0.0, 0.0, 0.5, 1.0])), 0)]

    def spoken(found):
        """Clutter of which some parts say what such parts say."""
        how = rng.random()
        return [(notice(rng, words) if rng.random() < how else t, *rest) for t, *rest in found]

    root = ("html", "body") + (tuple(["div", *name(["page", "wrapper", "container", "site", "root", "app"])]) if rng.random() < 0.4 else ())
    main = [str(rng.choice(["article", "main", "article"]))] if rng.random() < 0.65 else []
    if not main or rng.random() < 0.3:
        main += ["div" if rng.random() < 0.8 else "section", *name(CONTENT)]
    inside = (*root, *main)
    article = [(say(2, 12), (*inside, "h1"), 0.0, 1)] if rng.random() < 0.8 else []
    for _ in range(rng.integers(1, 14)):
        tag = rng.choice(["p", "p", "p", "p", "p", "h2", "h3", "li", "blockquote", "pre", "td"])
        own = {"li": ("ul", "li"), "td": ("table", "tbody", "tr", "td")}.get(tag, (tag,))
        if tag == "td" and rng.random() < 0.7:  # a table of figures or of few words
            cell = lambda: f"{rng.integers(0, 3000)}{rng.choice(['', '', '%', '.5', ' kg'])}" if rng.random() < 0.6 else say(1, 4)
            article += [(cell(), (*inside, *own[:-1], str(rng.choice(["td", "td", "td", "th"]))), 0.0, 1) for _ in range(rng.integers(4, 16))]
            continue
        inline = (rng.choice(["b", "em", "a", "span"]),) if rng.random() < 0.12 else ()
        article.append((say(1, 12) if tag[0] == "h" or rng.random() < 0.15 else say(3, 90), (*inside, *own, *inline), 1.0 if "a" in inline else float(rng.random() < 0.1) * 0.3, 1))
        if rng.random() < 0.06:
            article += spoken(clutter(inside))
    before = [b for _ in range(rng.integers(0, 4)) for b in spoken(clutter(root))]
    after = [b for _ in range(rng.integers(0, 4)) for b in spoken(clutter(root))]
    return before + article + after


#: Names of boxes that say nothing of what they hold. Fixed values.
NEUTRAL = "box wrap wrapper inner outer left right center top mid middle col column row cell grid panel block container layer level x y z".split()


def compose_plain(rng: np.random.Generator, words: np.ndarray) -> list[tuple[str, tuple[str, ...], float, int]]:
    """A made-up page whose markup does not name its parts: div soup, tables for layout, lines between breaks.

    What tells the article apart is its sentences, their run through the page, and the share of links elsewhere.
    """
    def say(lo, hi, end=""):
        text = " ".join(rng.choice(words, rng.integers(lo, hi)))
        return text.rstrip(".,;:!?") + end

    def own():
        if rng.random() < 0.45:
            return ()
        word = str(rng.choice(NEUTRAL)) if rng.random() < 0.5 else "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(1, 4)))
        return (f"{rng.choice(['cl', 'id'])}:{word}",)

    root = [("html", "body"), ("body",), ()][rng.integers(3)] + (("div", *own()) if rng.random() < 0.5 else ())
    kind = rng.integers(4)  # divs, table, breaks, bare
    frame = (*root, "table", *(("tbody",) if rng.random() < 0.4 else ()), "tr") if kind == 1 else root

    def box():
        if kind == 1:
            return (*frame, "td", *own())
        if kind == 3:
            return root
        return (*root, str(rng.choice(["div", "div", "div", "section", "center"])), *own(), *(("div", *own()) if rng.random() < 0.25 else ()))

    def sentence(lo, hi):
        return say(lo, hi, str(rng.choice([".", ".", ".", ".", "!", "?", "", '."'])))

    def clutter():
        base, what = box(), rng.integers(7)
        if what >= 5:
            return [(notice(rng, words), (*base, *(("a",) if rng.random() < 0.2 else ("p",) if rng.random() < 0.3 else ())), float(rng.choice([0.0, 0.0, 0.4, 1.0])), 0) for _ in range(rng.integers(1, 4))]
        if what == 0:
            return [(say(1, 4), (*base, "ul", "li", *(("a",) if rng.random() < 0.8 else ())), 1.0, 0) for _ in range(rng.integers(2, 8))]
        if what == 1:
            return [(say(1, 4), (*base, "a"), 1.0, 0) for _ in range(rng.integers(1, 7))]
        if what == 2:
            return [(say(2, 14), (*base, *(("a",) if rng.random() < 0.7 else ())), float(rng.uniform(0.75, 1.0)), 0)]
        if what == 3:
            return [(f"{rng.choice(['©', '(c)', 'Copyright'])} {rng.integers(1995, 2030)} {say(1, 6, str(rng.choice(['', '.'])))}", base, float(rng.choice([0.0, 0.0, 0.3])), 0)]
        return [(say(1, 4), (*base, str(rng.choice(["h3", "h4", "b"]))), 0.0, 0)] + [(say(2, 9), (*base, *rng.choice([("ul", "li"), ("div", "a")])), 1.0, 0) for _ in range(rng.integers(2, 6))]

    def article():
        base = box()
        inner = [("p",), ("div",), ("div", *own()), ()][rng.integers(4)]
        if rng.random() < 0.85:
            head = [("h1",), ("h1",), ("h2",), ("div", *own()), ("font",), ("b",)][rng.integers(6)]
            yield say(2, 12), (*base, *head), 0.0, 1
        for _ in range(rng.integers(2, 13)):
            if rng.random() < 0.12:
                for _ in range(rng.integers(2, 5)):
                    yield sentence(2, 30), (*base, "ul", "li"), 0.0, 1
                continue
            if rng.random() < 0.08:
                yield say(2, 8), (*base, str(rng.choice(["h2", "h3"]))), 0.0, 1
            yield sentence(5, 80) if rng.random() < 0.9 else sentence(1, 6), (*base, *inner), float(rng.uniform(0.02, 0.4)) if rng.random() < 0.2 else 0.0, 1

    before = [b for _ in range(rng.integers(0, 4)) for b in clutter()]
    after = [b for _ in range(rng.integers(0, 4)) for b in clutter()]
    if rng.random() < 0.06:
        return before + after
    return before + list(article()) + after


class Labeller:
    """The network: embeddings, two LSTM directions, a logistic output."""

    def __init__(self):
        rng = np.random.default_rng(SEED)
        f = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s).astype(np.float32)
        self.p = {"path": rng.normal(0, 0.2, (PATHS, EMBED)).astype(np.float32), "word": rng.normal(0, 0.02, (WORDS, EMBED)).astype(np.float32)}
        for d in "fb":
            self.p |= {f"w{d}": f(2 * EMBED + NUMBERS, 4 * HIDDEN), f"u{d}": f(HIDDEN, 4 * HIDDEN), f"c{d}": np.zeros(4 * HIDDEN, np.float32)}
        self.p |= {"o": f(2 * HIDDEN + 2 * EMBED + NUMBERS, 1)[:, 0], "bias": np.zeros(1, np.float32)}

    def inputs(self, page: list) -> tuple:
        """Hashed path and word ids of the blocks, flat, with their owners, and the numbers."""
        n = len(page)
        paths = [[*map(PATH_IDS.__getitem__, b[1]), PATH_IDS["/".join(b[1][-2:])]] for b in page]
        words = [list(map(WORD_IDS.__getitem__, b[0].lower().split())) for b in page]
        length = np.array([len(b[0]) for b in page], np.float32)
        place = np.arange(n, dtype=np.float32) / max(1, n - 1)
        numbers = np.stack([np.log1p(length) / 6, np.array([b[2] for b in page], np.float32), place, 1 - place, np.array([b[0][-1] in ".!?…" for b in page], np.float32), length / length.max(initial=1)], axis=1)
        return paths, words, numbers.astype(np.float32)

    def vectors(self, pages: list[tuple]) -> tuple[np.ndarray, tuple]:
        """One row for each block of all pages."""
        flat, owner, count = {}, {}, {}
        for k, part in (("path", 0), ("word", 1)):
            lists = [ids for p in pages for ids in p[part]]
            size = np.fromiter(map(len, lists), np.int64, len(lists))
            flat[k] = np.fromiter(chain.from_iterable(lists), np.int64, int(size.sum()))
            owner[k] = np.repeat(np.arange(len(lists)), size)
            count[k] = np.maximum(1, size)[:, None].astype(np.float32)
        n = len(count["path"])
        x = np.zeros((n, 2 * EMBED + NUMBERS), np.float32)
        for j, k in enumerate(("path", "word")):
            for e in range(EMBED):
                x[:, j * EMBED + e] = np.bincount(owner[k], self.p[k][flat[k], e], n)
        x[:, :EMBED] /= 2
        x[:, EMBED : 2 * EMBED] /= count["word"]
        x[:, 2 * EMBED :] = np.concatenate([p[2] for p in pages])
        return x, (flat, owner, count)

    def run(self, x: np.ndarray, at: np.ndarray, d: str) -> tuple[np.ndarray, list]:
        """States (time, page, HIDDEN). at: row of x by (time, page), -1 for padding (which comes last in a page)."""
        steps, b = at.shape
        gates, u = x @ self.p[f"w{d}"] + self.p[f"c{d}"], self.p[f"u{d}"]
        h = c = np.zeros((b, HIDDEN), np.float32)
        out, saved = np.zeros((steps, b, HIDDEN), np.float32), [None] * steps
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            live = (at[t] >= 0)[:, None]
            g = gates[at[t]] + h @ u
            s = 1 / (1 + np.exp(-g[:, : 3 * HIDDEN]))
            i, f, o = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :]
            n = np.tanh(g[:, 3 * HIDDEN :])
            new_c = f * c + i * n
            tc = np.tanh(new_c)
            saved[t] = (h, c, i, f, o, n, tc)
            c, h = np.where(live, new_c, c), np.where(live, o * tc, h)
            out[t] = h
        return out, saved

    def forward(self, pages: list[tuple]):
        x, parts = self.vectors(pages)
        sizes = [len(p[2]) for p in pages]
        first = np.cumsum([0, *sizes[:-1]])
        at = np.full((max(sizes), len(pages)), -1)
        for k, (s, n) in enumerate(zip(first, sizes, strict=True)):
            at[:n, k] = np.arange(s, s + n)
        runs = {d: self.run(x, at, d) for d in "fb"}
        t, k = np.nonzero(at >= 0)
        rows = at[t, k]
        top = np.zeros((len(x), 2 * HIDDEN + x.shape[1]), np.float32)
        top[rows] = np.hstack([runs["f"][0][t, k], runs["b"][0][t, k], x[rows]])
        logit = top @ self.p["o"] + self.p["bias"][0]
        return logit, (x, parts, at, runs, t, k, rows, top)

    def predict(self, pages: list[tuple]) -> list[np.ndarray]:
        """Whether each block is main text. Pages of like sizes go together."""
        out: list = [np.zeros(0, bool)] * len(pages)
        order = sorted((i for i in range(len(pages)) if len(pages[i][2])), key=lambda i: len(pages[i][2]))
        while order:
            own = [i for i in order[:TOGETHER] if len(pages[i][2]) <= 2 * len(pages[order[0]][2]) + 8]
            order = order[len(own) :]
            logit = self.forward([pages[i] for i in own])[0]
            for i, part in zip(own, np.split(logit, np.cumsum([len(pages[i][2]) for i in own])[:-1]), strict=True):
                out[i] = part > 0
        return out

    def step(self, pages: list[tuple], y: np.ndarray, state: dict) -> None:
        """One step of Adam on a batch of pages with labels y of all their blocks."""
        logit, (x, (flat, owner, count), at, runs, t, k, rows, top) = self.forward(pages)
        dl = ((1 / (1 + np.exp(-logit)) - y) / len(y)).astype(np.float32)
        grad = {"o": top.T @ dl, "bias": np.array([dl.sum()])}
        dtop = dl[:, None] * self.p["o"]
        dx = dtop[:, 2 * HIDDEN :].copy()
        for d, part in (("f", slice(0, HIDDEN)), ("b", slice(HIDDEN, 2 * HIDDEN))):
            u, dgates = self.p[f"u{d}"], np.zeros((len(x), 4 * HIDDEN), np.float32)
            dh, dc, du = np.zeros((at.shape[1], HIDDEN), np.float32), np.zeros((at.shape[1], HIDDEN), np.float32), np.zeros_like(u)
            for s in range(len(at) - 1, -1, -1) if d == "f" else range(len(at)):
                live = at[s] >= 0
                h, c, i, f, o, n, tc = runs[d][1][s]
                dh = dh + np.where(live[:, None], dtop[at[s], part], 0)
                dc2 = dc + dh * o * (1 - tc * tc)
                dg = np.hstack([dc2 * n * i * (1 - i), dc2 * c * f * (1 - f), dh * tc * o * (1 - o), dc2 * i * (1 - n * n)])
                dg[~live] = 0
                dgates[at[s][live]] = dg[live]
                du += h.T @ dg
                dh = np.where(live[:, None], dg @ u.T, dh)
                dc = np.where(live[:, None], dc2 * f, dc)
            grad |= {f"u{d}": du, f"w{d}": x.T @ dgates, f"c{d}": dgates.sum(axis=0)}
            dx += dgates @ self.p[f"w{d}"].T
        for j, key in enumerate(("path", "word")):
            g = np.zeros_like(self.p[key])
            each = dx[:, j * EMBED : (j + 1) * EMBED] / (2 if key == "path" else count[key])
            np.add.at(g, flat[key], each[owner[key]])
            grad[key] = g
        state["t"] = state.get("t", 0) + 1
        for key, g in grad.items():
            m, v = state.setdefault(key, [np.zeros_like(self.p[key]), np.zeros_like(self.p[key])])
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            self.p[key] -= (RATE * (m / (1 - 0.9 ** state["t"])) / (np.sqrt(v / (1 - 0.99 ** state["t"])) + 1e-6)).astype(np.float32)


def learn(pages: list[str]) -> Labeller:
    """A labeller from composed pages and from weakly labelled ones of the sample."""
    rng, net = np.random.default_rng(SEED), Labeller()
    parsed = [blocks(p) for p in pages]
    words = sorted({w for page in parsed for b in page for w in b[0].split()}) or ["text", "words", "here", "and", "there"]
    pool = np.array(words)
    made = [compose(rng, pool) for _ in range(COMPOSED)] + [compose_plain(rng, pool) for _ in range(PLAIN)]
    for page in parsed:
        labels = [weak_label(b[1]) for b in page]
        if 1 in labels:
            made.append([(*b, y or 0) for b, y in zip(page, labels, strict=True)])
    made = [[(text, narrowed((), list(path)), share, y) for text, path, share, y in m] for m in made if 0 < len(m) <= LONGEST_SAMPLE]
    data, y = [net.inputs(m) for m in made], [np.array([b[3] for b in m], np.float32) for m in made]
    state: dict = {}
    for _ in range(EPOCHS):
        order = np.argsort([len(v) + 4 * rng.random() for v in y])
        for pick in rng.permutation(len(order) // BATCH + 1):
            own = order[pick * BATCH : (pick + 1) * BATCH]
            if len(own):
                net.step([data[i] for i in own], np.concatenate([y[i] for i in own]), state)
    return net


def extract_text(pages: list[str | None], net: Labeller) -> list[str]:
    parsed = [blocks(p) for p in pages]
    keep = net.predict([net.inputs(p) for p in parsed]) if parsed else []
    return ["\n".join(b[0] for b, k in zip(p, ks, strict=True) if k) for p, ks in zip(parsed, keep, strict=True)]


def fit(pages: DataFrame) -> Labeller:
    """Learn on a bounded sample of pages, those of the least hashes."""
    n = max(1, pages.count())
    share = F.pmod(F.xxhash64("page_id"), F.lit(1 << 30)) < int(min(1.0, 1.5 * SAMPLE / n) * (1 << 30))
    sample = pages.filter(share & F.col("html").isNotNull()).orderBy(F.xxhash64("page_id"), "page_id").select("html").limit(SAMPLE)
    return learn([r["html"] for r in sample.collect()])


def extract(pages: DataFrame, net: Labeller | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every row."""
    held = pages.sparkSession.sparkContext.broadcast(net or fit(pages))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, len(b), TOGETHER):
                own = b.slice(k, TOGETHER)
                text = extract_text(own.column("html").to_pylist(), held.value)
                columns = [own.column("page_id"), own.column("url"), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    small_batches(pages.sparkSession)
    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(each, "page_id long, url string, text string, n_chars long")


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages", "page_id", "url", "html"))
