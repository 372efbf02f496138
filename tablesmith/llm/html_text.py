"""Layout-aware HTML rendering: all visible text of a page, laid out as plain text.

Tags, comments and text are read in order by one regular expression.  A tree builder keeps the
stack of open elements, closes what HTML closes by implication (paragraphs before blocks, list
items, table rows and cells, options), and drops end tags without a start.  It knows where the
open elements of each name stand, so a tag costs the same at any depth.  Elements that browsers
do not show are skipped whole: head parts, scripts, styles, templates, ``hidden`` attributes,
``display:none``, dialogs and details that are not open (but for their summary), and unrendered
controls.  ``visibility`` is inherited and may be set back inside.  Both properties are read from
``style`` attributes and from the page's own style elements, where a selector names a tag, an id
or classes of one element; other selectors and rules for print are passed over.

Blocks stand on lines of their own, paragraphs and headings with a blank line around them;
list items get a bullet or number and an indent by depth; ``br`` and ``pre`` keep their line
ends; the cells of a table are padded to aligned columns (a cell over n columns fills n, one over
n rows keeps its columns free in the rows below), with line ends inside a cell turned into spaces.

Defined cases: null and empty pages give an empty text; broken markup never fails: an unclosed
comment or raw-text element ends with the page, a lone ``<`` is text; nesting of any depth is
walked without recursion; repeated rows get equal results; extra columns are not looked at.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, ship, text_view

#: an attribute; a quote opens a value only straight after "=" and white space, elsewhere it is a character like others
ATTRIBUTE = re.compile(r"([^ \t\n\f\r/>][^ \t\n\f\r/>=]*+)(?:[ \t\n\f\r]*+=[ \t\n\f\r]*+"
                       r"(?:\"([^\"]*+)(?:\"|\Z)|'([^']*+)(?:'|\Z)|([^ \t\n\f\r>\"'][^ \t\n\f\r>]*+))?+)?+")
TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:-->|--!>|\Z))|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([A-Za-z][^\s/>]*)((?:[ \t\n\f\r/]++|" + re.sub(r"\((?=\[\^)", "(?:", ATTRIBUTE.pattern) + r")*+)(?:>|\Z)", re.S)
INVISIBLE = frozenset("area audio base canvas datalist embed head iframe link meta noembed noframes noscript object param "
                      "rp script source style template title track video svg math".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr keygen".split())
RAW = frozenset("script style textarea title iframe noembed noframes noscript xmp".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure "
                  "footer form h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav ol optgroup option p pre search "
                  "section summary table ul xmp caption tbody thead tfoot tr td th".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure xmp".split())
CLOSES_P = BLOCK - frozenset("td th tr tbody thead tfoot caption option optgroup html body".split()) | {"hr"}
SCOPE = frozenset({"td", "th", "table", "caption", "html", "template"})
#: where the search for an open list item stops
SPECIAL = BLOCK - frozenset("address div p dialog legend option optgroup li dd dt".split()) | frozenset(
    "applet button colgroup frameset head iframe listing marquee noembed noframes noscript object plaintext script select "
    "style template textarea title".split())
#: a start tag ends open elements of these names, looked for up to one of the limits
IMPLIED = {"li": ({"li"}, SPECIAL | {"dd", "dt"}), "dt": ({"dt", "dd"}, SPECIAL | {"li"}), "dd": ({"dt", "dd"}, SPECIAL | {"li"}),
           "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
           "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
           "tr": ({"tr", "td", "th", "caption"}, {"table"}), "tbody": ({"tbody", "thead", "tfoot", "caption"}, {"table"}),
           "thead": ({"tbody", "thead", "tfoot", "caption"}, {"table"}),
           "tfoot": ({"tbody", "thead", "tfoot", "caption"}, {"table"}),
           "button": ({"button"}, SCOPE | {"object"}), "rb": ({"rb", "rt", "rp", "rtc"}, SCOPE | {"ruby"}),
           "rt": ({"rb", "rt", "rp"}, SCOPE | {"ruby", "rtc"}), "rp": ({"rb", "rt", "rp"}, SCOPE | {"ruby", "rtc"}),
           "rtc": ({"rb", "rt", "rp", "rtc"}, SCOPE | {"ruby"})}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: what may stand in a head; any other start tag, and text, ends it
HEAD_PARTS = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
#: no start tag inside one of these ends an element outside
CLOSED_OFF = frozenset("template svg math noscript".split())
GAP = "  "
STYLE = re.compile(r"<style\b([^>]*)>(.*?)(?:</style\b|\Z)", re.I | re.S)
COMMENT = re.compile(r"<!--.*?(?:-->|\Z)", re.S)
CSS_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
#: a block of rules for a medium and the like, braces inside; or a statement
AT_RULE = re.compile(r"@[\w-]+[^{};]*(?:;|\{(?:[^{}]*\{[^{}]*\})*[^{}]*\})")
RULE = re.compile(r"([^{}]+)\{([^{}]*)\}")
SELECTOR = re.compile(r"([A-Za-z][\w-]*)?((?:[.#][\w-]+)*)")


def attributes(text: str) -> dict:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(text)}


def declared(text: str) -> tuple[str | None, str | None]:
    """(display, visibility) of a list of declarations, the last of each; None where it has none."""
    got = {}
    for part in text.lower().split(";"):
        name, _, value = part.partition(":")
        if name.strip() in ("display", "visibility"):
            got[name.strip()] = value.replace("!important", "").strip()
    return got.get("display"), got.get("visibility")


class Sheet:
    """The rules on display and visibility of a page's style elements, by the tag, id or class they need."""

    def __init__(self, source: str):
        self.rules: dict[str, list] = {}
        if "<style" not in source.lower():
            return
        n = 0
        for m in STYLE.finditer(COMMENT.sub("", source)):
            media = attributes(m[1]).get("media", "all").lower()
            if "all" not in media and "screen" not in media:
                continue
            for rule in RULE.finditer(AT_RULE.sub("", CSS_COMMENT.sub("", m[2]))):
                values = declared(rule[2])
                if values == (None, None):
                    continue
                for selector in rule[1].split(","):
                    x = SELECTOR.fullmatch(selector.strip())
                    if not x or not selector.strip():
                        continue
                    tag, marks = (x[1] or "").lower(), re.findall(r"[.#][\w-]+", x[2])
                    n += 1
                    weight = (sum(k[0] == "#" for k in marks), sum(k[0] == "." for k in marks), bool(tag), n)
                    self.rules.setdefault(marks[-1] if marks else tag, []).append((weight, tag, frozenset(marks), values))

    def of(self, tag: str, attrs: dict) -> tuple[str | None, str | None]:
        """(display, visibility) that the rules and then the style attribute give an element."""
        out = [None, None]
        if self.rules:
            own = {f".{k}" for k in attrs.get("class", "").split()} | ({f"#{attrs['id']}"} if attrs.get("id") else set())
            hits = [r for k in (tag, *own) for r in self.rules.get(k, ()) if r[1] in ("", tag) and r[2] <= own]
            for _, _, _, values in sorted(hits, key=lambda r: r[0]):
                out = [v or old for v, old in zip(values, out, strict=True)]
        if "style" in attrs:
            out = [v or old for v, old in zip(declared(attrs["style"]), out, strict=True)]
        return tuple(out)


def is_hidden(tag: str, attrs: dict) -> bool:
    return tag in INVISIBLE or "hidden" in attrs or tag == "dialog" and "open" not in attrs \
        or tag == "input" and attrs.get("type", "").lower() == "hidden"


class Page:
    """Lines under way: ``text`` collects one line, ``gap`` the line ends due before the next text."""

    def __init__(self):
        self.out, self.gap, self.space, self.prefix = [], 0, False, ""

    def line_end(self, n: int) -> None:
        self.gap, self.space = max(self.gap, n), False

    def write(self, s: str, indent: str) -> None:
        if self.gap or not self.out:
            if self.out:
                self.out.append("\n" * self.gap)
            self.out.append(indent if not self.prefix else self.prefix)
            self.gap, self.prefix, self.space = 0, "", False
        elif self.space:
            self.out.append(" ")
            self.space = False
        self.out.append(s)

    def flow(self, text: str, indent: str) -> None:
        """Text whose white space collapses."""
        words = text.split()
        if not words:
            self.space = self.space or bool(text) and not self.gap and bool(self.out)
            return
        self.space = self.space or text[0].isspace() and not self.gap and bool(self.out)
        self.write(" ".join(words), indent)
        self.space = text[-1].isspace()

    def lines(self, text: str, indent: str) -> None:
        """Text whose white space stays."""
        for k, line in enumerate(text.split("\n")):
            if k:
                self.gap += 1
                self.space = False
            if line.strip():
                self.write(line.rstrip("\r"), indent)

    def text(self) -> str:
        return "".join(self.out)


class Table:
    """Rows of cells (text, columns, rows)."""

    def __init__(self):
        self.rows, self.captions = [], []

    def grid(self) -> list[list]:
        """The text of each place: that of a cell at its first, None at those it covers beside and below."""
        busy: dict[int, int] = {}       # rows for which a cell above still covers a column
        out = []
        for row in self.rows:
            line, k, over = [], 0, {}
            for text, columns, rows in row:
                while k in busy:
                    line.append(None)
                    k += 1
                line += [text] + [None] * (columns - 1)
                over.update({k + j: rows for j in range(columns)})
                k += columns
            busy = {c: n - 1 for c, n in {**busy, **over}.items() if n > 1}
            out.append(line)
        return out

    def layout(self) -> list[str]:
        rows = [r for r in self.grid() if any(r)]
        width: list[int] = []
        for r in rows:
            width += [0] * (len(r) - len(width))
            for k, c in enumerate(r):
                width[k] = max(width[k], len(c or ""))
        return [*self.captions, *(GAP.join((c or "").ljust(w) for c, w in zip(r, width, strict=False) if w).rstrip() for r in rows)]


class Renderer:
    def __init__(self, sheet: Sheet):
        self.sheet = sheet
        self.page = Page()
        self.stack: list[str] = []
        self.at: dict[str, list[int]] = {}      # places in the stack by name
        self.shown = [True]                     # visibility around and in the open elements
        self.folded: list[list] = []            # [place, summary seen] of details that are not open
        self.skip = 0               # open elements inside an invisible one, itself included
        self.outer: list[tuple] = []     # (page, lists) around the open cells
        self.tables: list[Table] = []
        self.lists: list[list] = []      # [tag, next number]
        self.pre = 0

    @property
    def indent(self) -> str:
        return "  " * max(0, len(self.lists))

    def push(self, tag: str, visibility: str | None = None) -> None:
        self.at.setdefault(tag, []).append(len(self.stack))
        self.stack.append(tag)
        self.shown.append(visibility == "visible" if visibility in ("visible", "hidden", "collapse") else self.shown[-1])

    def pull(self) -> str:
        tag = self.stack.pop()
        self.at[tag].pop()
        self.shown.pop()
        if self.folded and self.folded[-1][0] == len(self.stack):
            self.folded.pop()
        return tag

    def innermost(self, names) -> int:
        """Place of the innermost open element of these names, -1 if none is open."""
        return max((x[-1] for n in names if (x := self.at.get(n))), default=-1)

    def in_fold(self) -> bool:
        return bool(self.folded) and self.folded[-1][0] == len(self.stack) - 1

    def open(self, tag: str, raw: str) -> None:
        # what the tag ends by implication may be the invisible element itself
        if self.stack and self.stack[-1] == "head" and tag not in HEAD_PARTS:
            self.close("head")
        if tag in CLOSES_P:
            self.close("p", SCOPE | CLOSED_OFF | {"button", "object", "applet", "marquee"})
        if tag in HEADINGS and self.stack and self.stack[-1] in HEADINGS:
            self.close(self.stack[-1])
        if tag == "a" and self.skip:
            self.close("a", SCOPE | CLOSED_OFF | {"object", "applet", "marquee"})
        if tag in IMPLIED:
            names, limits = IMPLIED[tag]
            limits = limits | CLOSED_OFF
            for _ in range(3):
                k = self.innermost(names)
                if k < 0 or self.innermost(limits) >= k:
                    break
                self.close(self.stack[k], limits)
        if self.skip:
            if tag not in VOID:
                self.push(tag)
                self.skip += 1
            return
        attrs = attributes(raw) if raw and raw != "/" else {}
        display, visibility = self.sheet.of(tag, attrs)
        folded = self.in_fold()
        if folded and tag == "summary" and not self.folded[-1][1]:
            self.folded[-1][1], folded = True, False
        if folded or display == "none" or is_hidden(tag, attrs):
            if tag not in VOID:
                self.push(tag)
                self.skip = 1
            return
        if tag in ("td", "th") and not self.tables:
            tag = "div"         # a cell outside a table
        if tag == "br":
            self.page.gap += 1
            self.page.space = False
        elif tag == "hr":
            self.page.line_end(2)
        if tag in VOID:
            return
        self.push(tag, visibility)
        if tag == "details" and "open" not in attrs:
            self.folded.append([len(self.stack) - 1, False])
        if tag in BLOCK:
            self.page.line_end(2 if tag in SPACED and not (tag in ("ul", "ol") and self.lists) else 1)
        if tag in ("ul", "ol", "menu", "dir"):
            start = attrs.get("start", "1")
            self.lists.append([tag, int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1])
        elif tag == "li":
            depth = "  " * max(0, len(self.lists) - 1)
            if self.lists and self.lists[-1][0] == "ol":
                self.page.prefix = f"{depth}{self.lists[-1][1]}. "
                self.lists[-1][1] += 1
            else:
                self.page.prefix = f"{depth}- "
        elif tag in ("pre", "xmp"):
            self.pre += 1
        elif tag == "table":
            self.tables.append(Table())
        elif tag == "tr" and self.tables:
            self.tables[-1].rows.append([])
        elif tag in ("td", "th", "caption") and self.tables:
            columns, rows = (attrs.get(k, "1") for k in ("colspan", "rowspan"))
            self.outer.append((self.page, self.lists, int(columns) if re.fullmatch(r"[1-9]\d{0,2}", columns) else 1,
                               1 << 16 if rows == "0" else int(rows) if re.fullmatch(r"[1-9]\d{0,4}", rows) else 1))
            self.page, self.lists = Page(), []

    def close(self, tag: str, limits=frozenset()) -> None:
        """Close the innermost open ``tag`` and all that is open inside it, unless a limit is met first."""
        k = self.innermost((tag,))
        if k < 0 or self.innermost(x for x in limits if x != tag) > k:
            return
        while len(self.stack) > k:
            self.ended(self.pull())

    def ended(self, tag: str) -> None:
        if self.skip:
            self.skip -= 1
            return
        if tag in ("td", "th", "caption"):
            if not self.outer:
                return
            cell = " ".join(self.page.text().split("\n"))
            cell = re.sub(r"(?<=\S) +", lambda m: m[0] if len(m[0]) == 2 else " ", cell).strip()
            self.page, self.lists, columns, rows = self.outer.pop()
            table = self.tables[-1]
            if tag == "caption":
                table.captions += [cell] if cell else []
            else:
                if not table.rows:
                    table.rows.append([])
                table.rows[-1].append((cell, columns, rows))
        elif tag == "table":
            for line in self.tables.pop().layout():
                self.page.write(line, self.indent)
                self.page.line_end(1)
        elif tag in ("ul", "ol", "menu", "dir"):
            if self.lists:
                self.lists.pop()
            self.page.prefix = ""
        elif tag in ("pre", "xmp"):
            self.pre -= 1
        if tag in BLOCK:
            self.page.line_end(2 if tag in SPACED and not (tag in ("ul", "ol") and self.lists) else 1)

    def text(self, s: str, literal: bool = False) -> None:
        if self.skip and self.stack[-1] == "head" and s.strip(" \t\n\f\r"):
            self.close("head")
        if self.skip or not s or self.in_fold() or not self.shown[-1]:
            return
        if not literal and "&" in s:
            s = html.unescape(s)
        if self.stack and self.stack[-1] in ("table", "tr", "tbody", "thead", "tfoot") and self.tables:
            if not s.strip():
                return
            # text between cells is shown before the table
            self.page.flow(s, self.indent)
            self.page.line_end(1)
            return
        if self.pre:
            self.page.lines(s, self.indent)
        else:
            self.page.flow(s, self.indent)


def render(source: str | None) -> str:
    """The visible text of one page."""
    if not source:
        return ""
    source = source.replace("\r\n", "\n").replace("\0", "")
    r, at, end = Renderer(Sheet(source)), 0, len(source)
    while at < end:
        m = TOKEN.search(source, at)
        if not m:
            r.text(source[at:])
            break
        r.text(source[at:m.start()])
        at = m.end()
        tag = m[2]
        if not tag:
            continue
        tag = tag.lower()
        if m[1]:
            if tag == "br":
                r.open("br", "")
            elif tag == "p" and not r.at.get("p") and not r.skip:
                r.page.line_end(2)
            elif tag not in VOID:
                limits = frozenset() if tag in ("table", "html", "body") else frozenset({"table"}) if tag in SCOPE or tag in (
                    "tr", "tbody", "thead", "tfoot") else SCOPE
                r.close(tag, limits if tag not in limits else frozenset())
            continue
        r.open(tag, m[3])
        if tag in RAW:          # text up to the end tag, without markup
            stop = re.compile(f"</{re.escape(tag)}(?=[\\s/>])", re.I).search(source, at)
            to = stop.start() if stop else end
            r.text(source[at:to], literal=tag == "xmp")
            at = to
    while r.stack:
        r.ended(r.pull())
    lines = [x.rstrip() for x in r.page.text().split("\n")]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip("\n")


def extract(pages: DataFrame, source: str = "html", page_id: str = "page_id") -> DataFrame:
    """(page_id, text, n_chars, n_lines) for every row."""
    d = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(source).cast("string").alias("html"))
    schema = pa.schema([("page_id", pa.int64()), ("text", pa.string()), ("n_chars", pa.int64()), ("n_lines", pa.int64())])

    def run(batches):
        for b in batches:
            _, offs = text_view(b.column(1))
            for i, j in pieces(offs):
                texts = [render(x) for x in b.column(1).slice(i, j - i).to_pylist()]
                yield pa.RecordBatch.from_arrays([
                    b.column(0).slice(i, j - i), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([t.count("\n") + 1 if t else 0 for t in texts], pa.int64())], schema=schema)

    return ship(d).mapInArrow(run, "page_id long, text string, n_chars long, n_lines long")
