"""Operator 8: main text of web pages as the maximum-scoring run of a page.

A page is a sequence of tags and pieces of text. Tags score negative. Words score by a logistic regression over their
neighbourhood, fitted on labelled pages: the share of link words in their block and around it, the block's size and
sentence marks, and the names and class words of the elements around them. An element that holds most of the page's
words says little about them, so its names count for little: no single word decides. One linear scan finds the
contiguous region of the largest total; its words of positive score, by block, are the text.

All steps are linear in the page's length: tags are found by searching forward, and once a tag is found not to end
outside quotes, later ones end at their first closing mark.

Defined results: null and empty pages, and pages without content words, have an empty text; character references are
decoded; white space inside a block is one space; blocks are joined by one line feed; repeated rows, null ids and null
urls keep their rows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querent.llm import tables

NAME = re.compile(r"/?([a-zA-Z][a-zA-Z0-9:-]*)")
MARK = re.compile(r"""[>"']""")
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
PART = re.compile(r"[a-z]+")
#: class words that say that something else is or is not there
MODIFIER = re.compile(r"(?:has|with|no|without|is|show|hide)[-_]")
SENTENCE = re.compile(r"""[.!?。！？]["'”’»)]*\s*$""")

BLOCKS = frozenset("address article aside blockquote body br button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html label legend li main menu nav ol option p pre section select summary table tbody td textarea tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: elements whose content is no text of the page
HIDDEN = frozenset("script style noscript template iframe svg title".split())
#: elements that a new block ends when they were left open
OPEN_END = {"p": BLOCKS - {"br", "button", "label"}, "li": frozenset({"li"}), "option": frozenset({"option"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"})}

TAG_COST = (0.02, 0.3)
PENALTY = 0.05
#: log odds at which a word scores 1, and what a text costs at most
MOST = 2.0
LIMIT = 6.0

#: labelled pages: words between ⟦ and ⟧ are content
LABELLED = (
    '<html><head><title>River news - Daily</title></head><body><header class="site-header"><a href="/">Daily</a> <span>Your paper</span></header><nav><ul><li><a>Home</a></li><li><a>Sports</a></li></ul></nav><main><article><h1>⟦River rises again⟧</h1><p>⟦The river rose by two metres in the night and the old bridge was closed to all traffic.⟧</p><aside class="sidebar related"><h3>Read more</h3><a>Flood of last year</a></aside><p>⟦Nobody was hurt, said the <a>mayor of the town</a> in the morning.⟧</p></article><section id="comments" class="comments"><h2>Comments</h2><div class="comment"><p>I saw it from my window it was great</p></div><form><label>Your comment</label><textarea>Write here</textarea><button>Send</button></form></section></main><footer><p>All rights reserved by the Daily, contact us</p></footer></body></html>',
    '<html><head><title>Bread</title></head><body><div id="cookie-notice" class="notice banner cookie">We use cookies to make this site better <button>Accept</button></div><div class="menu navigation"><a>Recipes</a><a>About</a><a>Shop</a></div><div class="ad advert">Buy the best flour at our shop now. You pay less for it.</div><div class="content post"><h2>⟦Plain bread⟧</h2><ul><li>⟦five hundred grams of flour⟧</li><li>⟦three hundred grams of water⟧</li></ul><p>⟦Mix everything, wait for an hour and bake it until it is brown.⟧</p><div class="share social"><a>Share</a><a>Tweet</a></div><blockquote>⟦Bread is the staff of life.⟧</blockquote></div><div class="sidebar widget"><p>Newest posts on the site and the archive</p></div><div class="footer copyright">Copyright by the baker</div></body></html>',
    '<html><body><div role="navigation" class="topbar header"><a>Login</a> <a>Register</a></div><div class="wrapper"><div class="entry text"><h1>⟦On walking⟧</h1><div>⟦I walk every day, rain or shine, along the same street to the sea and back.⟧</div><table><tr><td>⟦Monday⟧</td><td>⟦four miles⟧</td></tr></table><figure><figcaption>⟦The sea in winter⟧</figcaption></figure><div class="ads sponsored promo">Shoes for walkers. Half price this week only, click here.</div><p>⟦Some days I meet a friend and we talk about the weather.⟧</p></div><div class="comment-list discussion"><p>Nice text thank you for it</p><p>I walk too every single day</p></div><form class="newsletter subscribe signup"><label>Mail</label><select><option>weekly</option><option>daily</option></select></form></div><div id="footer"><a>Imprint</a> <a>Privacy</a></div></body></html>',
    '<html><head><title>Notes</title></head><body><article><header><h1>⟦A note about stars⟧</h1></header><section><h2>⟦Names⟧</h2><p>⟦Most names of stars are Arabic, many are Greek, and few are new.⟧</p><pre>⟦Vega Altair Deneb⟧</pre><dl><dt>⟦Vega⟧</dt><dd>⟦a bright star in the north⟧</dd></dl></section><div class="alert warning notice"><p>This page needs your help, please donate</p></div><footer class="byline meta">Filed under stars</footer></article><aside><p>Buy our book about the sky today</p></aside><div class="reader comments replies"><p>Deneb is far away indeed</p></div><footer>&copy; sky.example &middot; some closing words here.</footer></body></html>',
    '<html><body><div id="page" class="site layout"><header><h1>The Weekly</h1><p>News and views from the coast</p></header><div class="list main body"><article id="story" class="article meta list site"><header><h2>⟦A small harbour⟧</h2><span class="date">⟦by a local writer⟧</span></header><h3>⟦The boats⟧</h3><p>⟦There are <span>twelve boats</span> in the harbour, <em>most</em> of them <strong>old</strong>, and <code>one</code> is new.⟧</p><h4>⟦The people⟧</h4><section><h5>⟦Work⟧</h5><p>⟦They fish at night and sell in the morning.⟧</p><ol><li><p>⟦First the nets.⟧</p></li><li><i>⟦Then the hooks.⟧</i></li></ol><details><summary>⟦More⟧</summary><p>⟦The market opens at six.⟧</p></details><div><b>⟦Closed⟧</b> <u>⟦on Mondays⟧</u></div></section></article><div class="related links"><h3>Related</h3><span>other harbours</span></div></div><footer><div>Contact the paper</div></footer></div></body></html>',
    '<html><body class="home page with-sidebar"><div id="top" class="masthead"><a href="/">Coast Weekly</a> <a href="/in">Sign in</a></div><div class="path"><a href="/">Home</a> <a href="/t">Travel</a> <a href="/t/n">North</a></div><div class="has-image full"><h1>⟦The slow train north⟧</h1><p>⟦It leaves at six, and nobody on it is in a hurry.⟧</p><p>⟦We had bread, cheese and <a href="/m">a map</a> with us, and the whole day to look out of the window.⟧</p><p>⟦No bridge on the line is older than the one at the mill.⟧</p></div><div class="more"><h3>Next on this site</h3><a href="/1">Ten quiet towns</a><a href="/2">Boats of the lake</a><a href="/3">Where to eat well</a></div><div class="bottom">Copyright, terms and imprint of the weekly</div></body></html>',
    '<html><body><div class="top-bar"><ul><li><a>News</a></li><li><a>Culture</a></li><li><a>Weather</a></li></ul></div><div class="post-header"><h1>⟦Rain on the roofs⟧</h1><div class="post-meta">⟦by a guest of the town⟧</div></div><div class="post-body"><p>⟦For three weeks it has rained, and the gutters sing at night.⟧</p><p>⟦<a>The old weir</a> holds; <a>the new one</a> does not, as <a>everybody said</a> it would not.⟧</p><ul><li>⟦close the windows at night⟧</li><li>⟦keep the cellar dry⟧</li></ul><p>⟦Sh.⟧</p></div><div class="discussion"><h4>What readers say</h4><ul class="replies"><li><p>My roof leaks as well, and has for years now.</p></li><li><p>Thank you for writing about it at last.</p></li></ul></div><p class="copyright">Published by the town press, all rights reserved.</p></body></html>',
    '<html><head><title>Glass</title></head><body><nav><a>Start</a><a>Index</a></nav><div class="ad">Glasses of every size are sold here, order them today.</div><article><h1>⟦How glass is made⟧</h1><p><b>⟦Sand, soda and lime are melted together.<br>The rest is patience.⟧<p>⟦The furnace is never let out, not even on holidays.⟧</p><p>⟦It takes a day to cool.⟧</p><p>⟦Why.⟧</p></article><footer>&copy; glass.example &middot; a few words that close every page. One more sentence stands here.</footer></body></html>',
    '<html><body><div class="wrap"><p>⟦A page may have nothing around its text.⟧</p><p>⟦Then all of it is the text, from the first word to the last, and no one has to choose.⟧</p><p>⟦Short ones, too.⟧</p></div></body></html>',
    '<html><body><header class="masthead"><h1>Hill Gazette</h1><nav><a>Today</a><a>Archive</a></nav></header><section class="story"><h2>⟦A walk along the ridge⟧</h2><p>⟦The path is narrow and the wind is strong, so hold on to your hat.⟧</p><div class="ad">Boots and coats. Everything must go this weekend.</div><p>⟦From the top you see both lakes, and in the morning the sea.⟧</p><blockquote><p>⟦I came for a day and stayed for a year.⟧</p></blockquote><div class="promo box"><a>Book a room</a> <a>Rent a bicycle</a></div><p>⟦Go in May, when the grass is still short.⟧</p></section><aside class="widget"><h3>Most read</h3><ol><li><a>Storm over the hill</a></li><li><a>A new school</a></li></ol></aside><section class="comments"><p>The wind took my hat last year.</p><p>Both lakes are closed to boats now, be careful up there.</p></section><form><label>Write to us</label><input><button>Send it</button></form><footer><p>The Gazette is printed every week. Subscribe at the office.</p></footer></body></html>',
    '<html><body><table class="layout"><tr><td class="left"><a>One</a><br><a>Two</a><br><a>Three</a></td><td><h1>⟦Salt⟧</h1><p>⟦Salt is taken from the sea in shallow ponds, or from the ground.⟧</p><table><tr><th>⟦Pond⟧</th><th>⟦Tons⟧</th></tr><tr><td>⟦North⟧</td><td>⟦four⟧</td></tr></table><p>⟦Both kinds taste alike.⟧</p></td></tr></table><div class="note cookie">This site stores cookies on your machine. <button>Fine</button></div><div class="foot">Made by hand in the salt house, write to us</div></body></html>',
    '<html><body><div class="banner ad">Winter sale. Half price on all lamps until Sunday.</div><main><h1>⟦Lamps⟧</h1><div class="intro">⟦Before lamps there were candles, and before candles there was the fire.⟧</div><div>⟦Oil lamps burn <em>slowly</em>. A wick of cotton draws the oil.⟧</div><div>⟦Gas came later, and with it the first bright streets.⟧</div><div class="pager"><a>1</a><a>2</a><a>3</a><a>next page</a></div></main><div class="subscribe newsletter"><p>Get our letter every Friday, free of charge.</p><form><input><button>Sign up</button></form></div><footer><a>About</a> <a>Contact</a> <a>Jobs</a></footer></body></html>',
)


def tags(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """Start, end, name, whether it closes, and attributes of each tag; comments and hidden content have an empty name."""
    at, simple, low = 0, False, None
    while (start := page.find("<", at)) >= 0:
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = len(page) if end < 0 else end + 3
            yield start, at, "", False, ""
            continue
        m = NAME.match(page, start + 1)
        if not m and page[start + 1 : start + 2] not in ("!", "?"):
            at = start + 1  # a mark in the text
            continue
        end = -1
        if m and not simple:
            k = m.end()
            while (mark := MARK.search(page, k)) and mark[0] != ">":
                close = page.find(mark[0], mark.end())
                if close < 0:
                    mark = None
                    break
                k = close + 1
            if mark:
                end = mark.start()
            else:
                simple = True
        if end < 0:
            end = page.find(">", start + 1)
            if end < 0:
                return  # no tag ends from here on
        at = end + 1
        if not m:
            yield start, at, "", False, ""
            continue
        name, closing = m[1].lower(), page[start + 1] == "/"
        if name in HIDDEN and not closing and not page[at - 2] == "/":
            low = low or page.lower()
            close = low.find(f"</{name}", at) if len(low) == len(page) else _closing(page, name, at)
            end = page.find(">", close) if close >= 0 else -1
            at = len(page) if end < 0 else end + 1
            yield start, at, "", False, ""
            continue
        yield start, at, name, closing, page[m.end() : end]


def _closing(page: str, name: str, at: int) -> int:
    m = re.compile(f"</{name}", re.I).search(page, at)
    return m.start() if m else -1


def names(name: str, attributes: str, parent: str) -> tuple[str, ...]:
    """What an element is called: its tag, with its parent's for headers and footers, and its class words."""
    out = [name, f"{parent}>{name}"] if name in ("header", "footer") else [name]
    for m in ATTRIBUTE.finditer(attributes):
        for value in (m[2] or m[3] or m[4] or "").lower().split():
            if not MODIFIER.match(value):
                out += [f".{w}" for w in PART.findall(value)]
    return tuple(dict.fromkeys(out))


class Page:
    """A page's sequence of tags and texts, with the elements around each text and their counts of words."""

    def __init__(self, page: str):
        self.called: list[tuple[str, ...]] = [()]
        self.parent: list[int] = [0]
        self.words: list[int] = [0]
        self.links: list[int] = [0]
        self.is_block: list[bool] = [True]
        #: ("tag", name) or ("text", words, block, element, whether in a link)
        self.sequence: list[tuple] = []
        self.block_words, self.block_links, self.block_end = Counter(), Counter(), {}
        stack, open_names, at, self.block = [0], Counter(), 0, 0
        kinds = [""]
        for start, end, name, closing, attributes in tags(page):
            self._text(page, at, start, stack[-1], open_names["a"] > 0)
            at = end
            if not name:
                continue
            self.block += name in BLOCKS
            if closing:
                if open_names[name]:
                    while True:
                        gone = kinds[stack.pop()]
                        open_names[gone] -= 1
                        if gone == name:
                            break
            else:
                while kinds[stack[-1]] in OPEN_END and name in OPEN_END[kinds[stack[-1]]]:
                    open_names[kinds[stack.pop()]] -= 1
                if name not in VOID and not attributes.endswith("/"):
                    if name == "a" and open_names["a"]:  # links do not nest
                        while True:
                            gone = kinds[stack.pop()]
                            open_names[gone] -= 1
                            if gone == "a":
                                break
                    self.called.append(names(name, attributes, kinds[stack[-1]]))
                    self.parent.append(stack[-1])
                    self.words.append(0)
                    self.links.append(0)
                    self.is_block.append(name in BLOCKS)
                    kinds.append(name)
                    stack.append(len(kinds) - 1)
                    open_names[name] += 1
            self.sequence.append(("tag", name))
        self._text(page, at, len(page), stack[-1], open_names["a"] > 0)
        for i in range(len(kinds) - 1, 0, -1):  # children stand after their parents
            self.words[self.parent[i]] += self.words[i]
            self.links[self.parent[i]] += self.links[i]
        self.around: list[dict[str, float] | None] = [None] * len(kinds)

    def _text(self, page: str, start: int, end: int, element: int, link: bool) -> None:
        if end <= start:
            return
        text = html.unescape(page[start:end])
        n = len(text.split())
        self.words[element] += n
        self.block_words[self.block] += n
        if link:
            self.links[element] += n
            self.block_links[self.block] += n
        if n:
            self.block_end[self.block] = text[-80:]
        self.sequence.append(("text", text, self.block, element, link))

    def numbers(self, block: int, element: int, link: bool) -> tuple[float, ...]:
        """What the text's neighbourhood looks like."""
        own = element
        while not self.is_block[own]:
            own = self.parent[own]
        around = self.parent[own]
        n, all_words = max(1, self.block_words[block]), max(1, self.words[around])
        return (1.0, float(link), self.block_links[block] / n, self.links[around] / all_words, 1 / (1 + n), float(bool(SENTENCE.search(self.block_end.get(block, "")))))


def weight_of_element(words: int, total: int) -> float:
    return max(0.0, 1.0 - words / max(1, total))


NUMBERS = 6


@functools.cache
def model() -> tuple[np.ndarray, dict[str, float], dict[str, float]]:
    """Weights of the numbers and names, from the labelled pages, and the cost of each tag."""
    rows, y, size, tags_in, tags_out = [], [], [], Counter(), Counter()
    for page in LABELLED:
        # the marks stand in the texts and go through the scan like any word
        whole, plain = Page(page), Page(page.replace("⟦", "").replace("⟧", ""))
        first = next(i for i, x in enumerate(whole.sequence) if x[0] == "text" and "⟦" in x[1])
        last = max(i for i, x in enumerate(whole.sequence) if x[0] == "text" and "⟧" in x[1])
        texts = [x for x in plain.sequence if x[0] == "text"]
        inside = False
        k = 0
        for i, x in enumerate(whole.sequence):
            if x[0] == "tag":
                (tags_in if first < i < last else tags_out)[x[1]] += 1
                continue
            marks = x[1].replace("⟦", "").replace("⟧", "")
            content = inside or "⟦" in x[1]
            inside = x[1].rfind("⟦") > x[1].rfind("⟧") or (inside and "⟧" not in x[1])
            if not marks:  # only a mark, so that the plain page has no such text
                continue
            _, text, block, element, link = texts[k]
            k += 1
            if n := len(text.split()):
                rows.append((plain.numbers(block, element, link), elements_of(plain, element)))
                y.append(float(content))
                size.append(np.sqrt(n))
    vocabulary = {f: NUMBERS + i for i, f in enumerate(sorted({f for _, fs in rows for f in fs}))}
    x = np.zeros((len(rows), NUMBERS + len(vocabulary)))
    for i, (numbers, fs) in enumerate(rows):
        x[i, :NUMBERS] = numbers
        for f, v in fs.items():
            x[i, vocabulary[f]] = v
    y, size = np.array(y), np.array(size)
    balance = size * np.where(y == 1, 0.5 / size[y == 1].sum(), 0.5 / size[y == 0].sum())
    w, ridge = np.zeros(x.shape[1]), PENALTY / len(vocabulary)
    for _ in range(30):  # Newton steps
        p = 1 / (1 + np.exp(-x @ w))
        gradient = x.T @ (balance * (p - y)) + ridge * w
        curve = (x * (balance * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, gradient)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    low, high = TAG_COST
    cost = {t: low + (high - low) * (tags_out[t] + 0.5) / (tags_in[t] + tags_out[t] + 1) for t in tags_in | tags_out}
    return w[:NUMBERS], {f: float(w[i]) for f, i in vocabulary.items()}, cost


def elements_of(page: Page, element: int) -> dict[str, float]:
    """The names of the elements around a text; the nearest of a name counts, the less the more of the page it holds."""
    out: dict[str, float] = {}
    total = page.words[0]
    while element:
        value = weight_of_element(page.words[element], total)
        for f in page.called[element]:
            out.setdefault(f, value)
        element = page.parent[element]
    return out


def around_scores(page: Page, weights: dict[str, float]) -> list[float]:
    """For each element, the sum of the weights of the names around its texts; equal names inside one another count once, with the nearest."""
    total, out = page.words[0], [0.0] * len(page.called)
    held: list[dict[str, float]] = [{}] * len(page.called)
    for i in range(1, len(page.called)):
        above = held[page.parent[i]]
        known = [f for f in page.called[i] if f in weights]
        if not known:
            held[i], out[i] = above, out[page.parent[i]]
            continue
        value = weight_of_element(page.words[i], total)
        # at most one entry for each name of the labelled pages
        held[i] = above | {f: value for f in known}
        out[i] = sum(weights[f] * v for f, v in held[i].items())
    return out


def main_text(page: str | None) -> str:
    """The text of the best region of a page."""
    if not page:
        return ""
    numbers, weights, cost = model()
    read = Page(page)
    around = around_scores(read, weights)
    total = best = 0.0
    start = best_start = best_end = 0
    good: list[bool] = []
    for i, x in enumerate(read.sequence):
        if x[0] == "tag":
            score, ok = -cost.get(x[1], TAG_COST[0]), False
        else:
            n = len(x[1].split())
            each = float(np.dot(numbers, read.numbers(x[2], x[3], x[4]))) + around[x[3]] if n else 0.0
            ok = each > 0 if n else True
            score = n * min(1.0, max(-1.0, each / MOST))
            score = max(score, -LIMIT)  # a long comment may stand between two parts of an article
        good.append(ok)
        if total <= 0:
            total, start = 0.0, i
        total += score
        if total > best:
            best, best_start, best_end = total, start, i + 1
    out: list[str] = []
    last = None
    for x, ok in zip(read.sequence[best_start:best_end], good[best_start:best_end]):
        if x[0] == "tag" or not ok:
            continue
        if x[2] == last:
            out[-1] += x[1]
        else:
            out.append(x[1])
            last = x[2]
    return "\n".join(x for x in (" ".join(t.split()) for t in out) if x)


def extract(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """page_id, url and the main text of every row of pages(page_id, url, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                text = [main_text(x.as_py()) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(text, pa.string())], names=["page_id", "url", "text"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, "page_id long, url string, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark, tables.table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))
