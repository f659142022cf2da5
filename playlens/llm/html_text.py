"""Main text of web pages as the best-scoring contiguous region.

A page is a sequence of words and tags.  Words score by the elements they stand in,
tags score negatively; both weights are log-odds counted on labelled pages, that is
pages whose own markup names the content with one ``article`` or ``main`` element.  One
linear scan finds the contiguous run with the largest sum.  Elements that are never
article text (menus, forms, scripts, notices, comments ...) score nothing and are left out
of the run.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pages whose markup is counted to learn the weights, of those that name their content.
LABELLED_PAGES = 2000

# Fixed values of HTML: element names by what they mean for layout.
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset"
    " figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu"
    " nav ol option optgroup p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
_FLOW = frozenset(
    "a abbr b bdi bdo big blockquote br caption center cite code dd del dfn div dl dt em figcaption figure font h1 h2"
    " h3 h4 h5 h6 hr html body i img ins kbd li mark ol p pre q s samp section small span strike"
    " strong sub sup table tbody td tfoot th thead time tr tt u ul var wbr".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements whose content is no markup, up to their end tag or else the page's end.
_RAW = r"script|style|textarea|title(?!\s*/>)"
_EMBEDDED = frozenset("noscript template svg iframe object select canvas audio video annotation annotation-xml".split())
_NEVER = _EMBEDDED.union("nav aside footer header form button input label dialog menu head search".split())
_CONTENT = ("article", "main")
_CLOSES_P = _BLOCKS - {"html", "body", "head"}
# Words in class names and ids of elements that hold no article text, and words beside
# which they only describe the layout of what does.
_NEVER_NAMED = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments"
    " commentlist consent cookie cookies disqus footer header masthead menu modal nav navbar navigation"
    " newsletter notice notices pager pagination paywall popup promo promoted promotion related replies"
    " respond share sharing sidebar signup social sponsor sponsored subscribe toolbar widget widgets".split()
)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
# Elements that hold others; a name of theirs tells by its parts, that of other elements as a whole.
_CONTAINERS = frozenset("div section ul ol dl table tbody tr td center details span".split())
_LAYOUT = frozenset("article body container content has layout main no page post wrap wrapper with without".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(?P<raw>{_RAW})(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*>(?:.*?</(?P=raw)\s*>|.*\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-z][a-z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<[!?/][^>]*(?:>|\Z)"
    r"|<[a-z][^>]*(?:>|\Z)",
    re.S | re.I,
)
_ATTR = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
# Pages whose markup names content.
_NAMES_CONTENT = r"(?i)<(article|main)[\s>]"
_WORD = re.compile(r"\S+")
_SPACE = re.compile(r"\s+")


def _element(tag: str, attrs: str) -> tuple[tuple[str, ...], bool]:
    """Keys of an element for its weights, and if its content is never article text."""
    keys, never = [] if tag in _FLOW else [tag], tag in _NEVER
    for found in _ATTR.finditer(attrs) if attrs.strip() else ():
        name = found[1].lower()
        value = (found[2] or found[3] or found[4] or "").lower()
        if name == "hidden":
            never = True
        elif name == "aria-hidden":
            never = never or value == "true"
        elif name == "role":
            never = never or value in _ROLES
        elif name in ("class", "id"):
            names = value.split()
            keys += [f"{tag}.{part}" for part in names]
            never = never or tag not in ("html", "body", *_CONTENT) and any(_names_never(tag, n) for n in names)
    return tuple(keys), never


def _names_never(tag: str, name: str) -> bool:
    """If a class name or id says that an element is no article text.

    That of a container does if it starts or ends with such a word; that of a paragraph, an item
    or the like only if it is one; headings are judged by where they stand.
    """
    if tag in _HEADINGS:
        return False
    if tag not in _CONTAINERS:
        return name in _NEVER_NAMED
    parts = re.split("[_-]+", name)
    return (parts[0] in _NEVER_NAMED or parts[-1] in _NEVER_NAMED) and not _LAYOUT.intersection(parts)


def _events(page: str) -> Iterator[tuple]:
    """``("text", chunk, chain, never)`` and ``("tag", name, is_block, chain, never)`` in page order.

    ``chain`` holds the weight keys of all open elements; ``never`` is set inside an
    element that is no article text.  End tags close the nearest open element of that
    name; a block start closes an open paragraph.
    """
    stack: list[tuple[str, tuple[str, ...], bool]] = []
    at = 0

    def state():
        return (stack[-1][1], stack[-1][2]) if stack else ((), False)

    def breaks(tag: str, chain: tuple[str, ...], never: bool) -> bool:
        return tag in _BLOCKS and not (never and _EMBEDDED.intersection(chain))

    for found in _TOKEN.finditer(page):
        if found.start() > at:
            yield ("text", page[at : found.start()], *state())
        at = found.end()
        tag = found["tag"]
        if not tag:
            continue
        tag = tag.lower()
        if found["close"]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
            chain, never = state()
            yield ("tag", "/" + tag, breaks(tag, chain, never), chain, never or tag in _EMBEDDED)
            continue
        if tag in _CLOSES_P:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p":
                    del stack[i:]
                if i < len(stack) and (stack[i][0] in _BLOCKS or stack[i][0] in _EMBEDDED):
                    break
        keys, never = _element(tag, found["attrs"])
        chain, inside = state()
        chain, never = (*chain, *(k for k in keys if k not in chain)), never or inside
        if tag not in _VOID and not found["attrs"].endswith("/"):
            stack.append((tag, chain, never))
        yield ("tag", tag, breaks(tag, chain, never), chain, never)
    if at < len(page):
        yield ("text", page[at:], *state())


def count_markup(page: str) -> Counter:
    """How often each word context and tag stands in and outside of a labelled page's content.

    Empty for a page that does not name its content with exactly one element.
    """
    lowered = page.lower()
    if sum(len(re.findall(rf"<{name}[\s>]", lowered)) for name in _CONTENT) != 1:
        return Counter()
    counts: Counter = Counter()
    for kind, value, *rest in _events(page):
        chain, never = rest[-2:]
        inside = not never and any(name in chain for name in _CONTENT)
        if kind == "tag":
            counts["tag", value, inside] += 1
        else:
            words = len(_WORD.findall(value))
            counts["all", "", inside] += words
            for key in chain:
                counts["word", key, inside] += words
    return counts


#: Scores where no labelled page says otherwise.
DEFAULT_WEIGHTS = {"word": {"article": 4.0, "main": 2.0, "nav": -6.0, "footer": -6.0, "aside": -6.0, "header": -4.0, "form": -6.0}, "tag": {"nav": -8.0, "footer": -8.0, "/article": -4.0, "article": -1.0}, "prior": 1.0}


def weights_of(counts: dict[tuple[str, str, bool], int]) -> dict:
    """Log-odds from the counts; words in unseen contexts score the prior."""
    found = {"word": dict(DEFAULT_WEIGHTS["word"]), "tag": dict(DEFAULT_WEIGHTS["tag"]), "prior": DEFAULT_WEIGHTS["prior"]}
    total = {side: counts.get(("all", "", side), 0) for side in (True, False)}
    if not total[True]:
        return found
    prior = math.log((total[True] + 1) / (total[False] + 1))
    found["prior"] = min(3.0, max(0.5, prior))
    for kind, key in {k[:2] for k in counts if k[0] != "all"}:
        odds = math.log((counts.get((kind, key, True), 0) + 0.5) / (counts.get((kind, key, False), 0) + 0.5))
        if kind == "word":
            found["word"][key] = max(-12.0, min(12.0, odds - prior))
        else:
            found["tag"][key] = min(-0.05, max(-12.0, odds - 3.0) / 3)
    return found


def extract(page: str, weights: dict) -> str:
    """The article text of one page, its blocks joined by a line break."""
    words, tags, prior = weights["word"], weights["tag"], weights["prior"]
    pieces: list[tuple[str, bool, bool]] = []  # text, starts a block, never
    best = total = 0.0
    start, span = 0, (0, 0)
    memo: dict = {}
    for kind, value, *rest in _events(page):
        chain, never = rest[-2:]
        if kind == "tag":
            score = 0.0 if never or "math" in chain else tags.get(value, -0.5)
            pieces.append((" " if value == "br" else "", rest[0], never))
        else:
            if chain not in memo:
                memo[chain] = prior + sum(words.get(key, 0.0) for key in chain)
            n = len(value.split())
            score = 0.0 if never else n * max(-4.0, min(4.0, memo[chain]))
            pieces.append((value, False, never))
        total += score
        if total <= 0:
            total, start = 0.0, len(pieces)
        elif total > best:
            best, span = total, (start, len(pieces))
    blocks, open_block = [], []
    for text, is_block, never in pieces[span[0] : span[1]]:
        if is_block:
            blocks.append("".join(open_block))
            open_block = []
        elif not never:
            open_block.append(text)
    blocks.append("".join(open_block))
    return "\n".join(t for t in map(_clean, blocks) if t)


def _clean(block: str) -> str:
    return _SPACE.sub(" ", entities.unescape(block)).strip()


def learn_weights(pages: DataFrame, *, id_col: str, html_col: str = "html", sample: int = LABELLED_PAGES) -> dict:
    """Weights counted on the pages of ``sample`` ids at most, drawn by a hash from the pages that name their content.

    All that is counted there has a weight; the driver holds one number per tag and class name of these pages.
    """
    labelled = pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html")).filter(F.col("html").rlike(_NAMES_CONTENT))
    drawn = labelled.select("id").orderBy(F.xxhash64("id"), "id").limit(sample).distinct()
    chosen = labelled.join(F.broadcast(drawn), "id", "left_semi")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for page in batch.column(0).to_pylist():
                if page:
                    counts.update(count_markup(page))
        rows = [(*key, n) for key, n in counts.items()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.bool_(), pa.int64()))],
            names=["kind", "key", "inside", "n"],
        )

    counted = chosen.select("html").mapInArrow(count, "kind string, key string, inside boolean, n long")
    summed = counted.groupBy("kind", "key", "inside").agg(F.sum("n").alias("n"))
    return weights_of({(r.kind, r.key, r.inside): r.n for r in summed.collect()})


def main_text(
    pages: DataFrame, *, id_col: str, html_col: str = "html", keep: tuple[str, ...] = (), weights: dict | None = None
) -> DataFrame:
    """``text`` and its code points ``n_chars`` for every page, with the ``keep`` columns.

    Character references are decoded, white space and line breaks inside a block become one space, and
    blocks are joined by one line break.  A null, empty or text-free page gives an empty
    text; a page cut off in a tag loses that tag only.  Of runs with equal sums the first one that
    begins is taken, as far as its sum grows.  Pages are read whole, however long, one at a time.  Ids
    may be null or repeat: each row gets its own result.  Columns not in ``keep`` are left out,
    whatever their names; a kept column named ``text`` or ``n_chars`` is refused.
    """
    if clashing := {"text", "n_chars"}.intersection([id_col, *keep]):
        raise ValueError(f"results have columns of their own named {sorted(clashing)}")
    weights = weights or learn_weights(pages, id_col=id_col, html_col=html_col)
    given = pages.select(id_col, *keep, F.col(html_col).alias("__html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(page, weights) if page else "" for page in batch.column(batch.num_columns - 1).to_pylist()]
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=[id_col, *keep, "text", "n_chars"],
            )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema[:-1])
    return given.mapInArrow(run, f"{fields}, text string, n_chars long")
