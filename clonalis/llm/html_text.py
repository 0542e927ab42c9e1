"""Layout-aware text of web pages: a tree builder with implied tags, visibility rules, and a renderer
that keeps block spacing, lists and aligned table cells."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes".split())
IN_HEAD = frozenset("html head base basefont bgsound link meta title noscript noframes style script template".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center details dialog dd dir div dl dt fieldset figcaption figure footer form header hgroup html legend li main menu nav ol optgroup option p pre "
    "search section summary table ul xmp plaintext listing hr".split()
) | HEADINGS
SPACED = frozenset("blockquote dl figure fieldset menu ol p pre table ul hr xmp plaintext listing article".split()) | HEADINGS
CLOSES_P = BLOCKS - {"body", "html", "caption", "legend", "option", "optgroup"}
NEVER_SHOWN = frozenset("script style template noscript head title datalist iframe noembed noframes audio video canvas object rp source track param meta link base area".split())
#: Elements of drawings and formulas that are not shown, and those in which HTML goes on.
NOT_DRAWN = frozenset("desc defs metadata symbol clippath mask pattern marker annotation annotation-xml".split())
HTML_AGAIN = frozenset("foreignobject desc title mtext mi mo mn ms annotation-xml".split())
#: Tags that end an unclosed drawing or formula.
ENDS_DRAWING = HEADINGS | frozenset(
    "b big blockquote body br center code dd div dl dt em embed hr i img li listing menu nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split()
)
#: What a start tag ends, and the open elements that its search doesn't pass.
ENDS = {
    "li": (frozenset({"li"}), frozenset("ul ol menu dir td th caption table".split())),
    "dt": (frozenset({"dt", "dd"}), frozenset("dl td th caption table".split())),
    "option": (frozenset({"option"}), frozenset("select datalist".split())),
    "optgroup": (frozenset({"option", "optgroup"}), frozenset("select".split())),
    "td": (frozenset({"td", "th", "caption"}), frozenset({"table"})),
    "tr": (frozenset({"tr", "caption", "colgroup"}), frozenset({"table"})),
    "tbody": (frozenset({"tbody", "thead", "tfoot", "caption", "colgroup"}), frozenset({"table"})),
}
ENDS |= {"dd": ENDS["dt"], "th": ENDS["td"], "thead": ENDS["tbody"], "tfoot": ENDS["tbody"]}
SECTIONS = frozenset({"tbody", "thead", "tfoot"})
IN_TABLE = SECTIONS | {"caption", "colgroup", "col", "tr", "td", "th", "style", "script", "template"}
TABLE_PARTS = SECTIONS | {"table", "tr", "colgroup"}
#: Elements nested deeper keep their text, visibility and line breaks, but not the layout of lists and tables.
NESTED = 180
#: A cell's line that is longer doesn't widen its column; the rest of its row goes on below it, in its columns.
COLUMN = 120
_ATTRIBUTE = re.compile(r"""\s*/?\s*([^\s=>/][^\s=>/]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")
_CSS = re.compile(r""""(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?|\\.|[{};]""", re.S)
_DECLARATION = re.compile(r"\s*(display|visibility)\s*:\s*([a-z-]+)\s*(!\s*important)?\s*", re.I)
_COMPOUND = re.compile(r"(\*|[a-z][\w-]*)?((?:[.#][\w-]+|\[[^\]]*\])*)", re.I)
_MARK = re.compile(r"""([.#])([\w-]+)|\[\s*([\w-]+)\s*(?:=\s*("[^"]*"|'[^']*'|[\w-]+)\s*)?\]""")
#: Media queries that hold on every screen, and those that hold on none.
EVERY_SCREEN = frozenset({"", "all", "screen", "only all", "only screen", "not print", "not speech"})
_NO_SCREEN = re.compile(r"(?:only )?(?:print|speech)\b|not (?:all|screen)$")
_SPACES = re.compile(r"[ \t\n\f\r]+")


class _Open(list):
    """Open elements, and the places of those of each tag."""

    def __init__(self, nodes):
        super().__init__()
        self.places: dict[str, list[int]] = {}
        for node in nodes:
            self.append(node)

    def append(self, node) -> None:
        self.places.setdefault(node.tag, []).append(len(self))
        super().append(node)

    def pop(self):
        node = super().pop()
        self.places[node.tag].pop()
        return node

    def cut(self, place: int) -> None:
        while len(self) > place:
            self.pop()

    def innermost(self, tags) -> int:
        """Place of the innermost open element of the tags; 0 if there is none."""
        places = self.places
        if len(tags) < len(places):
            return max((places[t][-1] for t in tags if places.get(t)), default=0)
        return max((at[-1] for t, at in places.items() if at and t in tags), default=0)


class Node:
    __slots__ = ("attributes", "children", "shown", "tag")

    def __init__(self, tag: str, attributes: dict[str, str] | None = None):
        self.tag, self.attributes, self.children, self.shown = tag, attributes or {}, [], True


class TreeBuilder:
    """Builds the tree of a page; unclosed, crossed and missing tags are mended as browsers do."""

    def __init__(self):
        self.root = Node("html")
        self.open = _Open([self.root])
        self.title: str | None = None
        self.styles: list[tuple[str, str]] = []  # media and sheet
        self.drawn = False  # a drawing or formula has begun somewhere

    # tokens

    def feed(self, text: str) -> Node:
        at, n = 0, len(text)
        while at < n:
            lt = text.find("<", at)
            if lt < 0:
                self.text(text[at:])
                break
            if lt > at:
                self.text(text[at:lt])
            at = self.markup(text, lt)
        return self.root

    def markup(self, text: str, lt: int) -> int:
        after = text[lt + 1 : lt + 2]
        if text.startswith("<!--", lt):
            if text.startswith((">", "->"), lt + 4):
                return text.find(">", lt + 4) + 1
            end = text.find("-->", lt + 4)
            return len(text) if end < 0 else end + 3
        if after in ("!", "?") or (after == "/" and not text[lt + 2 : lt + 3].isalpha()):
            end = text.find(">", lt + 1)
            return len(text) if end < 0 else end + 1
        if after == "/":
            end = text.find(">", lt + 2)
            end = len(text) if end < 0 else end
            self.end(re.match(r"[^\s/>]*", text[lt + 2 : min(end, lt + 80)])[0].lower())
            return end + 1
        if not (after.isascii() and after.isalpha()):
            self.text("<")
            return lt + 1
        name = re.compile(r"[^\s/>]*").match(text, lt + 1)
        tag, at, attributes, closed = name[0].lower(), name.end(), {}, False
        while at < len(text) and text[at] != ">":
            found = _ATTRIBUTE.match(text, at)
            if not found:
                closed = text[at] == "/"
                at += 1
                continue
            closed = False
            value = found[2] or ""
            if value[:1] in "\"'" and value[-1:] == value[:1] and len(value) > 1:
                value = value[1:-1]
            attributes.setdefault(found[1].lower(), html.unescape(value))
            at = found.end()
        at += 1
        self.drawn = self.drawn or tag in ("svg", "math")
        if self.drawn and tag in ENDS_DRAWING:
            self.leave_drawing()
        closed = closed and self.drawn and (tag in ("svg", "math") or self.drawing() > 0)
        self.start(tag, attributes)
        if closed:
            if self.open[-1].tag == tag and len(self.open) > 1:
                self.open.pop()
            return at
        if tag in RAW or tag in ("title", "textarea"):
            close = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I).search(text, at)
            end = close.start() if close else len(text)
            self.raw(tag, text[at:end])
            return end
        if tag == "plaintext":
            self.raw(tag, text[at:])
            return len(text)
        return at

    # tree

    def raw(self, tag: str, text: str) -> None:
        if tag == "title":
            self.title = _SPACES.sub(" ", html.unescape(text)).strip() if self.title is None else self.title
        elif tag == "style":
            own = self.open[-1].attributes if self.open[-1].tag == "style" else {}
            self.styles.append((own.get("media", ""), text))
        if tag == "textarea":
            self.open[-1].children.append(html.unescape(text).removeprefix("\n"))
        elif tag in ("xmp", "plaintext"):
            self.open[-1].children.append(text)

    def text(self, text: str) -> None:
        if not text.strip(" \t\n\f\r"):
            if self.open[-1].tag not in TABLE_PARTS and self.open[-1].tag != "head":
                self.open[-1].children.append(" " if "\n" not in text else text)
            return
        self.leave_head()
        text = html.unescape(text) if "&" in text else text
        if self.open[-1].tag in TABLE_PARTS:
            self.foster(text)
        else:
            self.open[-1].children.append(text)

    def drawing(self) -> int:
        """Place of the innermost open drawing or formula, 0 if there is none or HTML goes on in it."""
        k = self.open.innermost(("svg", "math"))
        return k if k > self.open.innermost(HTML_AGAIN) else 0

    def leave_drawing(self) -> None:
        while k := self.drawing():
            self.open.cut(k)

    def leave_head(self) -> None:
        if self.open[-1].tag == "head":
            self.open.pop()

    def foster(self, child) -> None:
        """Content that a table can't have stands before it."""
        if k := self.open.innermost(("table",)):
            above = self.open[k - 1].children
            place = next((i for i in range(len(above) - 1, -1, -1) if above[i] is self.open[k]), len(above))
            above.insert(place, child)
            return
        self.open[-1].children.append(child)

    def close(self, tags: frozenset, stops: frozenset) -> None:
        k = self.open.innermost(tags)
        if k and k >= self.open.innermost(stops):
            self.open.cut(k)

    def start(self, tag: str, attributes: dict[str, str]) -> None:
        if tag in ("html", "body"):
            self.leave_head()
            self.root.attributes = {**attributes, **self.root.attributes}
            return
        if tag == "head":
            if len(self.open) == 1 and not self.root.children:
                self.push(Node("head"))
            return
        if tag not in IN_HEAD:
            self.leave_head()
        if tag in CLOSES_P:
            self.close(frozenset({"p"}), frozenset("td th caption button table".split()))
        if tag == "table" and self.open[-1].tag in TABLE_PARTS:
            self.close(frozenset({"table"}), frozenset())
        if tag in HEADINGS and self.open[-1].tag in HEADINGS:
            self.open.pop()
        if tag in ENDS:
            if tag in ("tr", *SECTIONS):
                self.close(frozenset({"td", "th"}), frozenset({"table"}))
            if tag in SECTIONS:
                self.close(frozenset({"tr"}), frozenset({"table"}))
            self.close(*ENDS[tag])
        if tag in ("td", "th", "tr") and self.open.places.get("table"):
            if self.open[-1].tag in ("table", "colgroup"):
                if self.open[-1].tag == "colgroup":
                    self.open.pop()
                self.push(Node("tbody"))
            if tag != "tr" and self.open[-1].tag in SECTIONS:
                self.push(Node("tr"))
        node = Node(tag, attributes)
        if self.open[-1].tag in TABLE_PARTS and tag not in IN_TABLE:
            self.foster(node)
            if tag not in VOID:
                self.open.append(node)
            return
        self.push(node, tag in VOID)

    def push(self, node: Node, leaf: bool = False) -> None:
        self.open[-1].children.append(node)
        if not leaf:
            self.open.append(node)

    def end(self, tag: str) -> None:
        if tag == "br":
            self.start("br", {})
        elif tag in HEADINGS:
            self.close(HEADINGS, frozenset("td th caption table".split()))
        elif tag in IN_TABLE or tag == "table":
            self.close(frozenset({tag}), frozenset() if tag == "table" else frozenset({"table"}))
        elif tag not in ("html", "body"):
            self.close(frozenset({tag}), frozenset("td th caption table".split()) if tag != "head" else frozenset())


def _on_screens(media: str) -> bool | None:
    """Whether a media query list holds on every screen (True), on none (False), or on some."""
    queries = [_SPACES.sub(" ", q).strip().lower() for q in media.split(",")]
    if any(q in EVERY_SCREEN for q in queries):
        return True
    return False if all(_NO_SCREEN.match(q) for q in queries) else None


def _rules(media: str, sheet: str) -> Iterator[tuple[str, list[str], bool]]:
    """(selectors, declarations, whether they hold on every screen) of a sheet's rules that hold on some screen."""
    sheet = re.sub(r"/\*.*?(?:\*/|\Z)", "", sheet, flags=re.S).replace("<!--", "").replace("-->", "")
    holds = [_on_screens(media)]
    rule: list[list[str] | None] = [None]  # declarations of the open rules; None for the bodies of at-rules
    names, start = [""], 0
    for token in [*_CSS.finditer(sheet), *(_CSS.finditer("}" * sheet.count("{")))]:
        if token[0] not in "{};":
            continue
        ends = len(sheet) if token.string is not sheet else token.start()
        text = sheet[start:ends].strip()
        start = len(sheet) if token.string is not sheet else token.end()
        if token[0] == "{":
            if rule[-1] is not None:  # nested in a rule
                own = False
            elif text.startswith("@"):
                kind, _, rest = re.sub(r"^@([\w-]*)", r"\1 ", text).partition(" ")
                own = {"media": _on_screens(rest), "layer": True, "supports": None, "container": None}.get(kind.lower(), False)
            else:
                own = True
            holds.append(False if own is False or holds[-1] is False else None if own is None or holds[-1] is None else True)
            rule.append(None if text.startswith("@") and rule[-1] is None else [])
            names.append(text)
            continue
        if rule[-1] is not None:
            rule[-1].append(text)
        if token[0] == "}" and len(names) > 1:
            declarations, name, applies = rule.pop(), names.pop(), holds.pop()
            if declarations is not None and applies is not False:
                yield name, declarations, applies is True


def _declared(declarations: list[str]) -> Iterator[tuple[str, str, bool]]:
    for declaration in declarations:
        if found := _DECLARATION.fullmatch(declaration):
            yield found[1].lower(), found[2].lower(), bool(found[3])


def _selector(selector: str) -> tuple[tuple, list] | None:
    """(specificity, compounds from the last one on, each with "" or > for what joins it to the one before it), if it
    has only tags, classes, ids, attributes, descendants and children."""
    chain, joined, ids, marks, tags = [], "", 0, 0, 0
    for part in re.sub(r"\s*>\s*", " > ", selector).split():
        if part == ">":
            if joined or not chain:
                return None
            joined = ">"
            continue
        found = _COMPOUND.fullmatch(part)
        wanted = _MARK.findall(found[2]) if found else []
        if not found or not found[0] or len(wanted) != len(re.findall(r"[.#][\w-]+(?![^\[]*\])|\[", found[2])):
            return None
        tag = (found[1] or "*").lower()
        ids, marks, tags = ids + sum(w[0] == "#" for w in wanted), marks + sum(w[0] != "#" for w in wanted), tags + (tag != "*")
        chain.append((joined, tag, [(kind, name or attribute.lower(), value.strip("\"'") if value else None) for kind, name, attribute, value in wanted]))
        joined = ""
    return None if joined or not chain else ((ids, marks, tags), chain[::-1])


def _is(node: Node, tag: str, wanted: list) -> bool:
    if tag != "*" and tag != node.tag and not (tag == "body" and node.tag == "html"):
        return False
    for kind, name, value in wanted:
        if kind == "." and name not in node.attributes.get("class", "").split():
            return False
        if kind == "#" and node.attributes.get("id") != name:
            return False
        if not kind and (name not in node.attributes or value is not None and node.attributes[name] != value):
            return False
    return True


def _fits(chain: list, node: Node, above: list[Node]) -> bool:
    """Whether a node with these ancestors fits the compounds of a chain."""
    joined, tag, wanted = chain[0]
    if not _is(node, tag, wanted):
        return False
    places = [len(above)]  # where the last compound may stand, the deepest first
    for further, tag, wanted in chain[1:]:
        tried = [i - 1 for i in places if i] if joined else range(places[0] - 1, -1, -1)
        places = [i for i in tried if _is(above[i], tag, wanted)]
        if not places:
            return False
        joined = further
    return True


class Visibility:
    """What is shown on some screen, by element, attributes and the style elements' rules for display and visibility,
    by importance, specificity and order. Rules under a condition (a width, @supports) never hide but may show; those
    for print, and selectors with pseudo-classes or siblings, don't count."""

    def __init__(self, styles: list[tuple[str, str]]):
        self.rules: dict[tuple[str, str], list] = {}  # by a mark or the tag of a selector's last compound
        order = 0
        for media, sheet in styles:
            for selectors, declarations, always in _rules(media, sheet):
                kept = [d for d in _declared(declarations) if always or d[1] not in ("none", "hidden", "collapse")]
                for selector in re.split(r",(?![^(\[]*[)\]])", selectors) if kept else []:
                    if parsed := _selector(selector):
                        order += 1
                        _, tag, wanted = parsed[1][0]
                        key = next(((kind, name) for kind, name, _ in wanted if kind), ("", tag))
                        self.rules.setdefault(key, []).append((*parsed, order, kept))

    def values(self, node: Node, above: list[Node]) -> dict[str, str]:
        best: dict[str, tuple] = {}
        a = node.attributes
        if self.rules:
            keys = [("", "*"), ("", node.tag), *((".", c) for c in a.get("class", "").split()), *([("#", a["id"])] if "id" in a else [])]
            for key in dict.fromkeys(keys):
                for specificity, chain, order, declared in self.rules.get(key, ()):
                    if _fits(chain, node, above):
                        for k, (name, value, important) in enumerate(declared):
                            best[name] = max(best.get(name, ((),)), ((important, 0, specificity, order, k), value))
        if "style" in a:
            for k, (name, value, important) in enumerate(_declared(a["style"].split(";"))):
                best[name] = max(best.get(name, ((),)), ((important, 1, (), 0, k), value))
        return {name: value for name, (_, value) in best.items()}

    def apply(self, node: Node, above: list[Node], hidden: bool = False, drawn: bool = False) -> None:
        """Sets shown of all elements below a node. Elements of a hidden one may be visible again."""
        above.append(node)
        frames = [(node, iter(node.children), hidden, drawn)]
        while frames:
            node, children, hidden, drawn = frames[-1]
            child = next(children, None)
            if child is None:
                frames.pop()
                above.pop()
                if frames and hidden:
                    node.children = [c for c in node.children if isinstance(c, Node) and c.shown]
                    node.shown = bool(node.children)
                elif frames and drawn and node.tag in ("text", "mtd"):
                    node.children = [" ", *node.children, " "]
                continue
            if isinstance(child, str):
                continue
            tag, a = child.tag, child.attributes
            if tag in NEVER_SHOWN or (drawn and tag in NOT_DRAWN) or (tag == "input" and a.get("type", "").lower() == "hidden"):
                child.shown = False
                continue
            own = self.values(child, above) if self.rules or "style" in a else {}
            if own.get("display", "none" if "hidden" in a or (tag == "dialog" and "open" not in a) else "") == "none":
                child.shown = False
                continue
            out_of_sight = own["visibility"] in ("hidden", "collapse") if own.get("visibility", "inherit") != "inherit" else hidden
            above.append(child)
            frames.append((child, iter(child.children), out_of_sight, tag in ("svg", "math") or (drawn and tag != "foreignobject")))

    def shows(self, node: Node) -> bool:
        return node.shown


class Flow:
    """Lines of a block: text fills the last one, blocks break it, and margins collapse."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.gap = self.blank = False  # a space, or an empty line, is due

    def text(self, text: str) -> None:
        words = _SPACES.split(text)
        if words[0] == "" and len(words) > 1:
            self.gap = True
        for i, word in enumerate(words):
            if not word:
                continue
            if self.line and (self.gap or i > 0):
                self.line.append(" ")
            self.due()
            self.line.append(word)
            self.gap = False
        if len(words) > 1 and words[-1] == "":
            self.gap = True

    def due(self) -> None:
        if self.blank and not self.line:
            if self.lines:
                self.lines.append("")
            self.blank = False

    def as_is(self, text: str) -> None:
        for i, part in enumerate(text.replace("\r\n", "\n").replace("\r", "\n").split("\n")):
            if i:
                self.wrap()
            if part:
                self.due()
                self.line.append(part.expandtabs(8))

    def wrap(self) -> None:
        """Ends the line even if it is empty."""
        self.due()
        self.lines.append("".join(self.line).rstrip())
        self.line, self.gap = [], False

    def end(self) -> None:
        """Ends a line that has text."""
        if self.line:
            self.wrap()
        self.gap = False

    def space(self) -> None:
        self.end()
        self.blank = True

    def block(self, lines: list[str]) -> None:
        self.end()
        if lines:
            self.due()
            self.lines += lines

    def done(self) -> list[str]:
        self.end()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        first = next((i for i, x in enumerate(self.lines) if x), len(self.lines))
        return self.lines[first:]


def _number(value: str | None, otherwise: int, most: int = 1 << 31) -> int:
    found = re.match(r"\s*(-?\d{1,9})", value or "")
    return min(int(found[1]), most) if found else otherwise


class Renderer:
    def __init__(self, visibility: Visibility):
        self.visibility, self.nested = visibility, 0

    def lines(self, node: Node, kept: bool = False) -> list[str]:
        flow = Flow()
        self.children(node, flow, kept)
        return flow.done()

    def children(self, node: Node, flow: Flow, kept: bool) -> None:
        if self.nested > NESTED:
            self.flat(node, flow, kept)
            return
        self.nested += 1
        for child in self.unfolded(node):
            if isinstance(child, str):
                flow.as_is(child) if kept else flow.text(child)
            elif self.visibility.shows(child):
                self.element(child, flow, kept)
        self.nested -= 1

    def unfolded(self, node: Node) -> list:
        if node.tag == "details" and "open" not in node.attributes:
            return [c for c in node.children if isinstance(c, Node) and c.tag == "summary"][:1]
        return node.children

    def flat(self, node: Node, flow: Flow, kept: bool) -> None:
        """Text of all below a node, without recursion: blocks, rows and items break lines, cells are set off by spaces."""
        frames = [(node, iter(self.unfolded(node)), kept)]
        while frames:
            node, children, kept = frames[-1]
            child = next(children, None)
            if child is None:
                frames.pop()
                if frames:
                    flow.text(" ") if node.tag in ("td", "th") else flow.end() if node.tag in BLOCKS or node.tag == "tr" else None
            elif isinstance(child, str):
                flow.as_is(child) if kept else flow.text(child)
            elif child.tag == "br":
                flow.wrap()
            elif self.visibility.shows(child) and child.tag not in VOID:
                flow.text(" ") if child.tag in ("td", "th") else flow.end() if child.tag in BLOCKS or child.tag == "tr" else None
                frames.append((child, iter(self.unfolded(child)), kept or child.tag in ("pre", "xmp", "plaintext", "listing", "textarea")))

    def element(self, node: Node, flow: Flow, kept: bool) -> None:
        tag = node.tag
        if tag == "br":
            flow.wrap()
        elif tag == "wbr" or tag in VOID and tag != "hr":
            return
        elif tag == "table":
            flow.space()
            flow.block(self.table(node))
            flow.space()
        elif tag in ("ul", "ol", "menu", "dir"):
            self.list(node, flow, kept)
        elif tag == "li":  # outside of a list
            flow.block(_prefixed("* ", self.lines(node, kept)))
        elif tag in ("dd", "blockquote"):
            (flow.space if tag == "blockquote" else flow.end)()
            flow.block(_prefixed("    ", self.lines(node, kept)))
            (flow.space if tag == "blockquote" else flow.end)()
        elif tag in BLOCKS:
            spaced = tag in SPACED
            (flow.space if spaced else flow.end)()
            if tag == "hr":
                return
            if tag in ("pre", "xmp", "plaintext", "listing", "textarea"):
                kept = True
                if node.children and isinstance(node.children[0], str):
                    node.children[0] = node.children[0].removeprefix("\n")
            self.children(node, flow, kept)
            (flow.space if spaced else flow.end)()
        elif tag in ("td", "th", "tr") or tag in SECTIONS:  # outside of a table
            flow.end() if tag not in ("td", "th") else flow.text(" ")
            self.children(node, flow, kept)
            flow.end() if tag not in ("td", "th") else flow.text(" ")
        else:
            self.children(node, flow, kept or tag == "textarea")

    def list(self, node: Node, flow: Flow, kept: bool) -> None:
        nested = flow.lines == [] and not flow.line
        flow.end() if nested else flow.space()
        number = _number(node.attributes.get("start"), 1)
        for child in node.children:
            if isinstance(child, str):
                if child.strip():
                    flow.end()
                    flow.text(child)
                    flow.end()
            elif not self.visibility.shows(child):
                continue
            elif child.tag == "li":
                if node.tag == "ol":
                    number = _number(child.attributes.get("value"), number)
                    mark, number = f"{number}. ", number + 1
                else:
                    mark = "* "
                flow.block(_prefixed(mark, self.lines(child, kept)) or [mark.rstrip()])
            elif child.tag in ("ul", "ol", "menu", "dir"):
                flow.block(_prefixed("  ", self.lines(_holder(child), kept)))
            else:
                self.element(child, flow, kept)
        flow.space()

    def rows(self, node: Node) -> Iterator[Node]:
        """Rows of a table; what stands beside them is a row of its own."""
        beside = Node("tr")
        for child in node.children:
            if isinstance(child, str) or child.tag in ("caption", "col", "colgroup") or not self.visibility.shows(child):
                continue
            if child.tag != "tr" and child.tag not in SECTIONS:
                beside.children.append(child)
                continue
            if beside.children:
                yield beside
                beside = Node("tr")
            if child.tag == "tr":
                yield child
            else:
                yield from self.rows(child)
        if beside.children:
            yield beside

    def cells(self, row: Node) -> Iterator[Node]:
        """Cells of a row, each with what stands after it."""
        cell, joined = None, False
        for child in row.children:
            if isinstance(child, Node) and child.tag in ("td", "th"):
                if cell:
                    yield cell
                cell, joined = child, False
            elif cell is None or self.visibility.shows(cell):
                if not joined:
                    own, cell, joined = cell, Node("td", cell.attributes if cell else {}), True
                    cell.children = [*own.children] if own else []
                cell.children.append(child)
        if cell:
            yield cell

    def table(self, node: Node) -> list[str]:
        """Cells of a row stand side by side, those of a column below each other."""
        out = []
        for child in node.children:
            if isinstance(child, Node) and child.tag == "caption" and self.visibility.shows(child):
                out += self.lines(child)
        grid: list[list[tuple[int, int, list[str]]]] = []
        taken: dict[int, int] = {}  # rows for which a column is still covered from above
        for row in self.rows(node):
            cells, column = [], 0
            fresh: dict[int, int] = {}
            for cell in self.cells(row):
                if not self.visibility.shows(cell):
                    continue
                while taken.get(column, 0):
                    column += 1
                wide = max(1, _number(cell.attributes.get("colspan"), 1, 1000))
                deep = max(1, _number(cell.attributes.get("rowspan"), 1, 65534))
                cells.append((column, wide, self.lines(cell)))
                if deep > 1:
                    fresh |= {column + k: deep - 1 for k in range(wide)}
                column += wide
            taken = {c: n - 1 for c, n in taken.items() if n > 1} | fresh
            grid.append(cells)
        widths: dict[int, int] = {}
        for cells in grid:
            for column, wide, lines in cells:
                if wide == 1:
                    widths[column] = max([widths.get(column, 0), *(len(x) for x in lines if len(x) <= COLUMN)])
        starts, place = {}, 0
        for column in sorted(widths):
            starts[column] = place
            place += widths[column] + 2 if widths[column] else 0
        for cells in grid:
            for k in range(max((len(c[2]) for c in cells), default=0)):
                line = ""
                for column, _, lines in cells:
                    if k < len(lines) and lines[k]:
                        at = starts.get(column, len(line))
                        if len(line) > max(at, COLUMN):
                            out.append(line)
                            line = ""
                        line = line.ljust(at) if len(line) <= at else line + "  "
                        line += lines[k]
                out.append(line)
        return [x.rstrip() for x in out]


def _holder(node: Node) -> Node:
    out = Node("div")
    out.children.append(node)
    return out


def _prefixed(mark: str, lines: list[str]) -> list[str]:
    rest = " " * len(mark)
    return [(mark if i == 0 else rest) + x if x or i == 0 else "" for i, x in enumerate(lines)]


def render(page: str) -> tuple[str, str | None]:
    """(visible text, title) of a page."""
    builder = TreeBuilder()
    root = builder.feed(page.replace("\0", ""))
    visibility = Visibility(builder.styles)
    visibility.apply(root, [])
    text = "\n".join(Renderer(visibility).lines(root))
    return text.replace(" ", " "), builder.title


def extract_text(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Per page: page_id, title, text, n_chars and n_lines of its visible text.

    Blocks start lines, paragraphs, headings, lists and tables are set off by one empty line, list items
    have marks or numbers and hang below each other, cells of a column start at the same place (after
    a line of over COLUMN characters the row goes on in the next line), and preformatted text is kept as it is. Null and empty
    pages have an empty text and no title; repeated rows each get a row; an empty table gives none;
    other columns are ignored.
    """
    source = pages.select(pages[id_col].alias("page_id"), pages[html_col].alias("html"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                found = [render(part.column("html")[i].as_py() or "") for i in range(part.num_rows)]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("page_id"), pa.array([t for _, t in found], pa.string()), pa.array([t for t, _ in found], pa.string()),
                        pa.array([len(t) for t, _ in found], pa.int64()), pa.array([t.count("\n") + 1 if t else 0 for t, _ in found], pa.int64()),
                    ],
                    names=["page_id", "title", "text", "n_chars", "n_lines"],
                )

    return source.mapInArrow(rows, f"page_id {source.schema['page_id'].dataType.simpleString()}, title string, text string, n_chars bigint, n_lines bigint")
