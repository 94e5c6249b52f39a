"""A tolerant reader of HTML: elements with their path of styles, and text blocks in page order."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field
from functools import cache

import xxhash

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|[^<]+", re.S)
_ODD_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(?:>|$)")  # with an unpaired quote
_ATTRIBUTE = re.compile(r"""(class|role|id|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=[\s/]|$)""", re.I)
_DIGITS = re.compile(r"\d+")
# Fixed names of the language.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "object", "select", "option", "annotation", "annotation-xml"}
SWALLOWING = {"script", "style", "textarea", "title"}  # without an end tag these hold the rest of the page; of others only the tag is left out
_OPTION_END = re.compile(r"</option[^>]*>|(?=<option[\s>]|</?optgroup[\s>]|</select[\s>]|</datalist[\s>])", re.I)  # its end tag is optional
_IN_TEXT = {"svg", "script", "style", "template", "noscript", "annotation", "annotation-xml"}  # do not break a line
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label",
          "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
          "math", "mi", "mn", "mo", "ms", "mtext", "mspace", "mrow", "mfrac", "msqrt", "mroot", "mstyle", "merror", "mpadded", "mphantom", "msub", "msup",
          "msubsup", "munder", "mover", "munderover", "mmultiscripts", "mprescripts", "mtable", "mtr", "mtd", "semantics"}
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
ROOT = {"html", "body", "article", "main", "section", "div", "td", "th", "li", "ul", "ol", "table", "blockquote", "aside", "nav", "header", "footer", "form"}


@cache
def _end_of(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I)


@dataclass
class Element:
    tag: str
    node: int  # a hash of the styles from the root to it: its place in the style tree
    marks: str = ""  # class, id and role, lower-case, for telling furniture
    parent: "Element | None" = None
    children: list[str] = field(default_factory=list)
    blocks: list[str] = field(default_factory=list)  # of its whole branch, for the style tree
    unnamed: str = ""  # its marks without the id
    in_article: bool = False  # itself or an element around it is an article


def _style(tag: str, attributes: str) -> tuple[str, str, str]:
    """(what the style tree calls the element, its marks, those without the id): tag and classes without numbers."""
    found = {}
    if attributes and not attributes.isspace():
        for name, value in _ATTRIBUTE.findall(attributes):
            found[name.lower()] = value.strip("\"'").lower()
    classes = ".".join(sorted(_DIGITS.sub("", found.get("class", "")).split()))
    hidden = " hidden" if "hidden" in found or found.get("aria-hidden") == "true" else ""
    marks, unnamed = (" ".join(found.get(k, "") for k in names) + hidden for names in (("class", "id", "role"), ("class", "role")))
    return (f"{tag}.{classes}" if classes else tag), marks.strip(), unnamed.strip()


def key(text: str) -> int:
    value = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))
    return value - (1 << 64) if value >= 1 << 63 else value


def read(text: str, branches: bool = False) -> tuple[list[Element], list[tuple[Element, str]]]:
    """(elements, blocks): every element that is not inline, and each text block with the element it stands in.

    Elements come in page order, each after the one it stands in. With ``branches`` they list the blocks of their whole
    branch, which takes as much as blocks times depth; without, time and space are linear in the text. A block ends where an element that is not inline starts or ends. Character references are decoded,
    white space within a block becomes one space. Elements whose text is not page text are left out.
    """
    root = Element("", 0)
    elements, blocks, stack, inline, current, at = [], [], [root], [], [], 0
    unclosed: set[str] = set()

    def flush() -> None:
        words = " ".join("".join(current).split())
        current.clear()
        if words:
            blocks.append((stack[-1], words))
            up = stack[-1] if branches else None
            while up is not None:
                up.blocks.append(words)
                up = up.parent

    while at < len(text):
        m = _TOKEN.match(text, at) or _ODD_TAG.match(text, at)
        token = m[0] if m else text[at]
        at += len(token)
        if m is None or m[2] is None:
            if not token.startswith(("<!", "<?")) and not any(hidden for _, hidden in inline):
                current.append(html.unescape(token))
            continue
        tag = m[2].lower()
        if not m[1]:
            if tag in RAW:
                if not m[3].rstrip().endswith("/") and tag not in unclosed:
                    end = (_OPTION_END if tag == "option" else _end_of(tag)).search(text, at)
                    if end is None:
                        unclosed.add(tag)  # nor will a later one be
                    at = end.end() if end else len(text) if tag in SWALLOWING else at
                if tag not in _IN_TEXT:
                    flush()
                continue
            if tag in INLINE:
                if tag == "br":
                    current.append(" ")
                elif tag not in VOID and not m[3].rstrip().endswith("/"):
                    # text of an advert within a line is left out without breaking the line
                    inline.append((tag, _inserted(_style(tag, m[3]), stack)))
                continue
            flush()
            if tag in CLOSES:
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth].tag in CLOSES[tag]:
                        del stack[depth:]
                        break
                    if stack[depth].tag in ROOT:
                        break
            elif stack[-1].tag == "p":  # a block element ends an open paragraph
                stack.pop()
            if tag in VOID:
                continue
            if stack[-1].tag == "head" or tag in ("article", "main"):  # what was never closed does not hold the article
                for depth in range(1, len(stack)):
                    if stack[depth].tag in ("head", "nav", "header"):
                        del stack[depth:]
                        break
            style, marks, unnamed = _style(tag, m[3])
            stack[-1].children.append(style)
            new = Element(tag, key(f"{stack[-1].node}/{style}"), marks, stack[-1], unnamed=unnamed)
            new.in_article = stack[-1].in_article or is_article(new)
            stack.append(new)
            elements.append(new)
            inline.clear()
        elif tag in INLINE:
            for depth in range(len(inline) - 1, -1, -1):
                if inline[depth][0] == tag:
                    del inline[depth:]
                    break
        else:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    flush()
                    del stack[depth:]
                    inline.clear()
                    break
    flush()
    return elements, blocks


# Words of class, id and role that name what is not the article.
FURNITURE_TAGS = {"nav", "footer", "aside", "form", "dialog", "menu", "head", "button", "fieldset"}
_PARTS = (r"ads?|adverts?|advertisements?|advertising|adsense|sponsor(?:ed|s)?|promos?|promotions?|banners?|nav|navbar|navigation|menus?|"
          r"breadcrumbs?|masthead|top-?bar|side-?bars?|widgets?|cookies?|consent|gdpr|pop-?ups?|modals?|overlay|newsletters?|subscribe|"
          r"signup|sign-?up|login|sharing|comments?|respond|replies|reply|disqus|recommended|"
          r"recommendations|pagination|pager|skip-?links?")
_WHOLE = (r"(?:site-?|page-?|main-?|global-?)?(?:header|footer)|notices?|alerts?|search(?:-?form|-?box|-?bar)?|share|related(?:-?posts?|-?articles?|-?links?)?|"
          r"hidden|contentinfo|complementary|colophon|form|subscription(?:-?(?:form|box))?|social(?:-?(?:links?|icons?|media|share|bar|buttons?|nav))?")
_FURNITURE = re.compile(rf"(?:^|[\s_-])(?:{_PARTS})(?=$|[\s_-])|(?:^|\s)(?:{_WHOLE})(?=$|\s)")
_INSERTED = re.compile(r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|sponsored|promo|hidden|skip-?link)(?=$|[\s_-])")
# Within an article whole names only, as parts of them may be its topic; an id of these elements names their topic too.
_FURNITURE_INSIDE = re.compile(rf"(?:^|\s)(?:{_PARTS}|{_WHOLE})(?=$|\s)")
_INSERTED_INSIDE = re.compile(r"(?:^|\s)(?:ads?|adverts?|advertisements?|sponsored|promo|hidden|skip-?link)(?=$|\s)")
_TOPICS = {"h1", "h2", "h3", "h4", "h5", "h6", "p", "section"}


def furniture(marks: str) -> bool:
    return bool(marks) and _FURNITURE.search(marks) is not None


_ASIDE_ARTICLE = re.compile(r"(?:^|[\s_-])(?:comments?|repl(?:y|ies)|ads?|adverts?|sponsored|promo|related|teaser)(?=$|\s)")


def is_article(element: Element) -> bool:
    return element.tag == "main" or (element.tag == "article" and not _ASIDE_ARTICLE.search(element.marks))


def _inserted(style: tuple[str, str, str], stack: list[Element]) -> bool:
    if _INSERTED.search(style[1]) is None:
        return False
    return not stack[-1].in_article or _INSERTED_INSIDE.search(style[1]) is not None


def is_furniture(element: Element, around_article: bool = False) -> bool:
    """The element by itself, by its tag or marks. A header is one outside an article only.

    Marks of an element around the article describe the page (``with-sidebar``) and do not count.
    """
    if element.tag in FURNITURE_TAGS or element.tag == "article" and not is_article(element):
        return True
    if element.tag not in ("html", "body", "article", "main") and not around_article and furniture(element.marks):
        if not element.parent.in_article:
            return True
        if _FURNITURE_INSIDE.search(element.unnamed if element.tag in _TOPICS else element.marks):
            return True
    return element.tag == "header" and not element.parent.in_article
