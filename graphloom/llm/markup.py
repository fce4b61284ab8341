"""Clean text with its structure from HTML, Markdown, wiki and LaTeX markup, alone or mixed (problem 5).

A page is cut into leaf blocks: lines of text, headings and list items of the DOM, blocks of code and
candidates for formulas. A linear-chain CRF labels each block from its ancestor tags, its opener, the shape
of its line and its neighbours, and Viterbi picks the best sequence. It is trained on labelled pages
(``pages.labelled_pages``) that are made from templates in all four kinds of markup.

Defined cases
* of several fetches of a page the last with non-null html counts (of equally late ones the greatest html)
* null and empty html give no element and null or empty text
* what is not shown (comments, scripts, styles, print-only and display:none parts) is left out, and so is
  markup that is shown literally (escaped, in nowiki, in code)
* unclosed comments, code and tags run to the end of the page; CRLF and LF are the same
* a formula counts where it stands; its repetition as MathML, annotation and image is one formula
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .crf import LinearChainCrf

LABELS = ["text", "hidden", "heading", "item", "code", "formula"]
KINDS = ["heading", "item", "code", "formula"]

_TOKEN = re.compile(
    r"""
    (?:(?=[<{\\$`~])|(?=^[ ]{1,3}[`~]))  # no markup begins with anything else: letters are passed over at once
    (?:
    (?P<comment><!--.*?(?:-->|\Z))
  | (?P<raw><(?P<rawtag>script|style|noscript|template)\b[^>]*>.*?(?:</(?P=rawtag)\s*>|\Z))
  | (?P<nowiki><nowiki\s*>.*?(?:</nowiki\s*>|\Z)|<nowiki\s*/>)
  | (?P<code><(?P<codetag>pre|syntaxhighlight|source)\b(?P<codeattr>[^>]*)>(?P<codetext>.*?)(?:</(?P=codetag)\s*>|\Z))
  | (?P<inline><(?P<inltag>code|tt|kbd|samp)\b[^>]*>(?P<inltext>.*?)</(?P=inltag)\s*>)
  | (?P<math><(?P<mathtag>math|ce|chem)\b[^>]*>(?P<mathtext>.*?)(?:</(?P=mathtag)\s*>|\Z))
  | (?P<ref><ref\b[^>]*?/>|<ref\b[^>]*>.*?</ref\s*>)
  | (?P<verb>\\begin\{(?P<verbenv>verbatim|lstlisting|minted|Verbatim|alltt)\*?\}(?P<verbtext>.*?)(?:\\end\{(?P=verbenv)\*?\}|\Z))
  | (?P<env>\\begin\{(?P<envname>equation|align|gather|multline|eqnarray|displaymath|math|flalign|alignat)(?P<envstar>\*?)\}(?P<envtext>.*?)\\end\{(?P=envname)\*?\})
  | (?P<fence>^[ ]{0,3}(?P<fencemark>`{3,}|~{3,})[^\n`]*\n(?P<fencetext>.*?)(?:^[ ]{0,3}(?P=fencemark)[`~]*[ \t]*$|\Z))
  | (?P<template>\{\{(?=\s*[A-Za-z#]))
  | (?P<escape>\\[$#%&_{}*`~\-+.!>|])
  | (?P<dd>\$\$(?P<ddtext>.+?)\$\$)
  | (?P<bracket>\\\[(?P<brtext>.+?)\\\])
  | (?P<paren>\\\((?P<patext>.+?)\\\))
  | (?P<tick>(?P<ticks>`+)(?!`)(?P<ticktext>[^\n]+?)(?<!`)(?P=ticks)(?!`))
  | (?P<dollar>\$(?![\s$])(?P<dotext>[^$\n`]*?[^\s$\\`])\$(?!\d))
  | (?P<tag><(?P<close>/?)(?P<name>[A-Za-z][A-Za-z0-9]*)\b(?P<attr>(?:[^<>"']|"[^"]*"|'[^']*')*)>)
    )
""",
    re.S | re.M | re.X,
)
_PIECES = ("comment", "raw", "nowiki", "code", "inline", "math", "ref", "verb", "env", "fence", "template", "escape", "dd", "bracket", "paren", "tick", "dollar", "tag")
_BLOCK_TAGS = {"p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "dl", "dd", "dt", "table", "tr", "td", "th", "br", "blockquote", "section", "article", "tbody", "thead", "caption", "hr", "figure", "body", "html", "head", "main"}
_VOID = {"br", "hr", "img", "input", "meta", "link", "wbr", "col", "source"}
_CLOSED_BY = {"li": {"li"}, "p": {"p"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_SCOPE = {"li": {"ul", "ol"}, "dd": {"dl"}, "dt": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "p": {"div", "td", "li", "body", "blockquote"}}
_UNSEEN = re.compile(r"""class\s*=\s*["'][^"']*\b(?:noprint|mw-editsection|printonly|mw-empty-elt|reference)\b|style\s*=\s*["'][^"']*display\s*:\s*none|\shidden\b""", re.I)
_SHAPES = [
    ("eqhead", re.compile(r"^(={1,6})(?!=)\s*\S.*?\s*(?<!=)\1\s*$")),
    ("under=", re.compile(r"^={2,}\s*$")),
    ("under-", re.compile(r"^-{2,}\s*$")),
    ("hash ", re.compile(r"^#{1,6}[ \t]+\S")),
    ("hashx", re.compile(r"^[#*]*#[#*]*[^\s#*]")),
    ("star ", re.compile(r"^\s*\*+[ \t]+\S")),
    ("bold", re.compile(r"^\s*(\*{1,2})[^\s*][^*]*\1(?!\*)")),
    ("starx", re.compile(r"^\*+[^\s*]")),
    ("dash ", re.compile(r"^\s*[-+][ \t]+\S")),
    ("num ", re.compile(r"^\s*\d+[.)][ \t]+\S")),
    ("section", re.compile(r"^\s*\\(?:part|chapter|(?:sub){0,2}section|(?:sub)?paragraph)\*?\s*\{")),
    ("bsitem", re.compile(r"^\s*\\item\b")),
    ("latexenv", re.compile(r"^\s*\\(?:documentclass|usepackage|begin|end|title|author|date|maketitle)\b")),
    ("percent", re.compile(r"^\s*%")),
    ("quote", re.compile(r"^>")),
    ("bar", re.compile(r"^\s*(?:\{?\||\|\})")),
    ("cat", re.compile(r"^\[\[(?:Category|File|Image):", re.I)),
    ("colon", re.compile(r"^[:;]")),
]
_CUES = {
    "wiki": re.compile(r"\[\[|'''|''\w|\{\{|^=+[^=\n]+=+\s*$", re.M),
    "md": re.compile(r"\]\(http|^```|^~~~|\*\*\w|\b__\w|^\S.*\n(?:={3,}|-{3,})\s*$|^[-+] \w", re.M),
    "latex": re.compile(r"\\(?:begin|section|textbf|emph|href)\b"),
    "dom": re.compile(r"<(?:p|div|ul|ol)\b"),
}


@dataclass
class Block:
    opener: str
    offset: int
    text: str
    tags: tuple[str, ...] = ()
    shape: str = ""
    line: int = -1
    blank_before: bool = False
    blank_after: bool = True
    level: int = 0
    feats: list[str] = field(default_factory=list)


def _shape(line: str) -> str:
    for name, rx in _SHAPES:
        if rx.match(line):
            return name
    return "plain"


def _braces(page: str) -> dict[int, int]:
    """Where each brace is closed; braces behind a backslash are words."""
    closed, open_at = {}, []
    for m in re.finditer(r"\\[{}]|[{}]", page):
        if m[0] == "{":
            open_at.append(m.start())
        elif m[0] == "}" and open_at:
            closed[open_at.pop()] = m.start()
    return closed


def _pieces(page: str) -> Iterator[tuple[str, int, int, re.Match]]:
    """(kind, start, end, match) of all markup. A template reaches to its own closing braces, however deep others stand in it."""
    closed = _braces(page) if "{{" in page else {}
    at = 0
    while m := _TOKEN.search(page, at):
        kind = next(k for k in _PIECES if m[k] is not None)
        at = max(m.end(), m.start() + 1)
        if kind == "template":
            end = closed.get(m.start())
            if end is None or closed.get(m.start() + 1) != end - 1:
                continue  # not closed: words
            at = end + 1
        yield kind, m.start(), at, m


def leaf_blocks(page: str) -> list[Block]:
    """Leaf blocks of a page in order."""
    page = page.replace("\r\n", "\n").replace("\r", "\n")
    blocks: list[Block] = []
    stack: list[tuple[str, bool, bool]] = []  # tag, unseen, formula element
    buf: list[str] = []
    state = {"start": 0, "line": 0, "blank": True, "heading": None}

    def tags() -> tuple[str, ...]:
        out = [t for t, _, _ in stack]
        return tuple(out + ["unseen"] * any(u for _, u, _ in stack))

    def in_formula() -> bool:
        return any(f for _, _, f in stack)

    def flush(at: int, newline: bool) -> None:
        text = "".join(buf)
        buf.clear()
        if text.strip():
            b = Block("line", state["start"], text, tags(), _shape(text), state["line"], state["blank"])
            b.level = len(text) - len(text.lstrip())
            blocks.append(b)
            state["blank"] = False
        elif newline:
            if blocks and blocks[-1].opener == "line" and not state["blank"]:
                blocks[-1].blank_after = True
            state["blank"] = True
            if stack and stack[-1][0] == "p":  # a blank line ends a paragraph that nothing closed
                stack.pop()
        if newline:
            state["line"] += 1
        state["start"] = at

    def words(text: str, at: int) -> None:
        if in_formula() or any(u and t in ("span", "sup") for t, u, _ in stack):
            return
        if state["heading"] is not None and text.strip():
            blocks.append(Block("h", state["heading"][0], "", tags(), "plain", state["line"], level=state["heading"][1]))
            state["heading"] = None
        parts = text.split("\n")
        for i, part in enumerate(parts):
            if not buf:
                state["start"] = at
            buf.append(part)
            at += len(part) + 1
            if i < len(parts) - 1:
                flush(at, True)

    def put(opener: str, at: int, text: str) -> None:
        if in_formula():
            return
        if state["heading"] is not None and opener != "comment":
            words("\ufffc", at)
        blocks.append(Block(opener, at, text, tags(), "", state["line"], state["blank"]))

    def lines(text: str) -> None:
        state["line"] += text.count("\n")

    at = 0
    for kind, begin, end, m in _pieces(page):
        if begin > at:
            words(page[at:begin], at)
        at, g = end, m.group
        if kind in ("comment", "raw"):
            put(kind, m.start(), g())
            lines(g())
        elif kind == "nowiki":
            words(re.sub(r"</?nowiki\s*/?>", "", g()).replace("\n", " ") if not in_formula() else "", m.start())
        elif kind in ("inline", "tick"):
            words("\ufffd" + (g("inltext") if kind == "inline" else g("ticktext")).replace("\n", " ") + "\ufffd", m.start())
        elif kind == "escape":
            words(g()[1], m.start())
        elif kind in ("ref", "template"):
            whole = page[begin:end]
            if kind == "template" and "\n" in whole:
                flush(begin, False)
            put("aside", begin, whole)
            lines(whole)
        elif kind in ("code", "verb", "fence"):
            flush(m.start(), False)
            put({"code": "code_" + (g("codetag") or ""), "verb": "code_env", "fence": "code_fence"}[kind], m.start(), g({"code": "codetext", "verb": "verbtext", "fence": "fencetext"}[kind]))
            lines(g())
        elif kind in ("math", "env", "dd", "bracket", "paren", "dollar"):
            text = g({"math": "mathtext", "env": "envtext", "dd": "ddtext", "bracket": "brtext", "paren": "patext", "dollar": "dotext"}[kind])
            put("formula_" + kind, m.start(), text)
            words("\ufffc", m.start())
            lines(g())
        else:
            name, attr = g("name").lower(), g("attr")
            if name in _BLOCK_TAGS:
                flush(m.end(), False)
            if g("close"):
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == name:
                        del stack[i:]
                        break
                if re.match(r"h[1-6]$", name):
                    state["heading"] = None
                continue
            if name in _CLOSED_BY:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in _SCOPE[name]:
                        break
                    if stack[i][0] in _CLOSED_BY[name]:
                        del stack[i:]
                        break
            element = 'mwe-math-element' in attr
            if element:
                put("formula_element", m.start(), _source_of(page, name, m.end()))
                words("\ufffc", m.start())
            elif name == "img" and "mwe-math-fallback" in attr:
                put("formula_element", m.start(), html_lib.unescape((re.search(r'alt="([^"]*)"', attr) or [None, ""])[1]))
            if name in _VOID or attr.rstrip().endswith("/"):
                continue
            stack.append((name, bool(_UNSEEN.search(attr)) and not element, element))
            if re.match(r"h[1-6]$", name):
                state["heading"] = (m.start(), int(name[1]))
            elif name == "li":
                blocks.append(Block("li", m.start(), tags=tags(), shape="plain", line=state["line"], level=sum(t in ("ul", "ol") for t, _, _ in stack), text="1." if next((t for t, _, _ in reversed(stack) if t in ("ul", "ol")), "ul") == "ol" else ""))
    words(page[at:], at)
    flush(len(page), True)
    blocks.sort(key=lambda b: b.offset)
    _describe(page, blocks)
    return blocks


def _element_end(page: str, name: str, at: int) -> int:
    """End of the element ``name`` whose opening tag ends at ``at``, by counting; the page's end if nothing closes it."""
    depth = 1
    for m in re.compile(rf"<(/?){name}\b[^>]*?(/?)>", re.I).finditer(page, at):
        depth += -1 if m[1] else 0 if m[2] else 1
        if not depth:
            return m.start()
    return len(page)


def _source_of(page: str, name: str, at: int) -> str:
    """TeX source of a formula element: its annotation, else alternative text."""
    part = page[at : _element_end(page, name, at)]
    m = re.search(r'<annotation[^>]*>(.*?)</annotation>', part, re.S) or re.search(r'alttext="([^"]*)"', part) or re.search(r'alt="([^"]*)"', part)
    text = html_lib.unescape(m[1]).strip() if m else ""
    inner = re.fullmatch(r"\{\\displaystyle\s*(.*)\}", text, re.S)
    return inner[1].strip() if inner else text


def _describe(page: str, blocks: list[Block]) -> None:
    """Features of every block: ancestors, opener, line shape, neighbours, and cues of the whole page."""
    cues = [name for name, rx in _CUES.items() if rx.search(page)]
    only = "+".join(cues) or "none"
    line_blocks = [b for b in blocks if b.opener == "line"]
    before: dict[int, Block] = {}
    after: dict[int, Block] = {}
    for a, b in zip(line_blocks, line_blocks[1:]):
        before[id(b)], after[id(a)] = a, b
    for b in blocks:
        f = b.feats
        f.append("o=" + b.opener)
        f += ["t=" + t for t in set(b.tags)]
        f.append("inner=" + (b.tags[-1] if b.tags else "none"))
        if b.opener in ("h", "li") or b.opener.startswith(("code", "formula")):
            f.append("unseen" if "unseen" in b.tags else "seen")
            f.append(f"{b.opener}&{'unseen' if 'unseen' in b.tags else 'seen'}")
        if b.opener.startswith("formula"):
            f.append(f"{b.opener}&" + ("math" if re.search(r"[\\^_=<>+]", b.text) else "nomath"))
            f.append(f"{b.opener}&" + ("digit" if b.text[:1].isdigit() else "nodigit"))
            f.append(f"{b.opener}&n={min(len(b.text.split()), 8)}")
            f.append(f"{b.opener}&" + ("prose" if re.search(r"[a-z]{2}[.,;]? [A-Za-z]?[a-z]{2}", b.text) and "\\" not in b.text else "noprose"))
        if b.opener != "line":
            continue
        free = not (set(b.tags) - {"div", "body", "html"})
        f.append("free" if free else "bound")
        s = b.shape if free else "bound"
        f.append("s=" + s)
        text = re.sub(r"^[\s#*=+\-\d.)>]+|[\s=#]+$", "", b.text)
        low = text.split()
        f.append(f"{s}&n={min(len(low), 8)}")
        f.append(f"{s}&" + ("stop" if text.endswith((".", "!", "?", ";")) else "nostop"))
        lower = sum(w[:1].islower() for w in low[1:] if w not in ("and", "of", "the", "de", "al", "in", "at", "van"))
        f.append(f"{s}&" + ("lower" if lower else "nolower"))
        f.append(f"{s}&" + ("join" if {"and", "of"} & set(low) else "nojoin"))
        f.append(f"{s}&cues={only}")
        f += [f"{s}&{c}" for c in cues]
        p, n = before.get(id(b)), after.get(id(b))
        close_p = p is not None and p.line == b.line - 1
        close_n = n is not None and n.line == b.line + 1
        f.append(f"{s}&p=" + (p.shape[:4] if close_p else "gap"))
        f.append(f"{s}&n=" + (n.shape[:6] if close_n else "gap"))
        lists = ("hash ", "hashx", "star ", "starx", "dash ", "num ")
        alone = not (close_p and p.shape in lists) and not (close_n and n.shape in lists)
        f.append(f"{s}&" + ("alone" if alone else "listed"))
        f.append(f"{s}&" + ("alone" if alone else "listed") + f"&{only}&" + ("join" if {"and", "of"} & set(low) else "lower" if lower else "nolower"))
        # a hash at the line's front is a list in one dialect and a heading in another: what else is on the page?
        f.append(f"{s}&" + ("wiki" if "wiki" in cues else "nowiki") + "&" + ("md" if "md" in cues else "nomd"))
        if re.search(r"(#+)\s*$", b.text):
            f.append(f"{s}&closed")


_model: list[LinearChainCrf] = []


def trained() -> LinearChainCrf:
    """The CRF, trained once per process on the labelled pages."""
    if not _model:
        from .pages import labelled_pages

        seqs, tags = [], []
        for page, spans in labelled_pages(700):
            blocks = leaf_blocks(page)
            seqs.append([b.feats for b in blocks])
            tags.append([target(b, spans) for b in blocks])
        _model.append(LinearChainCrf(LABELS).fit(seqs, tags, epochs=6))
    return _model[0]


def label_at(spans: list[tuple[int, int, str]], offset: int) -> str:
    inside = [(e - s, lab) for s, e, lab in spans if s <= offset < e]
    return min(inside)[1] if inside else "text"


def target(b: Block, spans: list[tuple[int, int, str]]) -> str:
    """Training label. What a line only holds (a formula, the words of a heading or item) is another block's."""
    label = label_at(spans, b.offset)
    held = b.opener == "line" and (label in ("formula", "code") or any(re.fullmatch(r"h[1-6]|li", t) for t in b.tags))
    return "text" if held and label != "hidden" else label


def label_page(page: str, model: LinearChainCrf) -> list[tuple[Block, str]]:
    blocks = leaf_blocks(page)
    return list(zip(blocks, model.decode([b.feats for b in blocks])))


def _plain(text: str) -> str:
    text = re.sub(r"\[\[(?:[^\]|]*\|)?([^\]|]*)\]\]", r"\1", text)
    text = re.sub(r"\[([^\]]*)\]\(\S*?\)", r"\1", text)
    text = re.sub(r"\\href\{[^{}]*\}\{([^{}]*)\}", r"\1", text)
    text = re.sub(r"\\[A-Za-z]+\*?\{([^{}]*)\}", r"\1", text)
    text = re.sub(r"'{2,}|(?<!\w)(\*\*|__|\*|_)(?=\S)|(?<=\S)(\*\*|__|\*|_)(?!\w)", "", text)
    return re.sub(r"[ \t\u00a0]+", " ", html_lib.unescape(text)).strip()


def _line_level(b: Block, label: str, after: Block | None) -> tuple[int, bool]:
    """Depth of a heading or item that a line's own marks give, and whether the item is numbered."""
    text = b.text
    if label == "heading":
        if m := re.match(r"\s*(={1,6}|#{1,6})", text):
            return len(m[1]), False
        if m := re.match(r"\s*\\(part|chapter|(?:sub)*section|(?:sub)?paragraph)", text):
            return {"part": 1, "chapter": 1, "section": 1, "subsection": 2, "subsubsection": 3, "paragraph": 4, "subparagraph": 5}.get(m[1], 1), False
        return (2 if after is not None and after.shape == "under-" else 1), False
    if m := re.match(r"[#*]+", text):
        return len(m[0]), m[0][-1] == "#"
    indent = len(text) - len(text.lstrip())
    return 1 + indent // 2, bool(re.match(r"\s*\d+[.)]", text))


def clean_text(page: str, model: LinearChainCrf) -> str:
    """Clean text: as many ``#`` as its level before a heading, ``- `` or ``1. `` before items, indented by depth, fences round code, dollars round formulas."""
    out: list[str] = []
    held: list[str] = []
    prefix = ""
    numbers: dict[int, int] = {}

    def item(level: int, numbered: bool) -> str:
        level = max(level, 1)
        for k in [k for k in numbers if k > level]:
            del numbers[k]
        numbers[level] = numbers.get(level, 0) + 1 if numbered else 0
        return "  " * (level - 1) + (f"{numbers[level]}. " if numbered else "- ")

    found = label_page(page, model)
    for i, (b, label) in enumerate(found):
        if label == "code":
            out += ["```", re.sub(r"</?\w[^>]*>", "", html_lib.unescape(b.text)).strip("\n"), "```"]
        elif label == "formula":
            held.append("$" + re.sub(r"\s+", " ", b.text).strip() + "$")
        elif b.opener in ("h", "li") and label in ("heading", "item"):
            prefix = "#" * max(b.level, 1) + " " if label == "heading" else item(b.level, b.text == "1.")
        elif b.opener == "line" and label != "hidden" and not b.shape.startswith(("under", "latexenv", "cat")):
            text = b.text
            if label in ("heading", "item"):
                level, numbered = _line_level(b, label, found[i + 1][0] if i + 1 < len(found) else None)
                text = re.sub(r"^\s*(?:[#*=+\-]+|\d+[.)]|\\item\b)\s*|\s*[=#]+\s*$", "", text)
                prefix = "#" * level + " " if label == "heading" else item(level, numbered)
            elif not prefix:
                numbers.clear()
            out.append(prefix + _plain(text.replace("\ufffd", "")))
            prefix = ""
        if label == "heading":
            numbers.clear()
    formulas = iter(held)
    return re.sub("\ufffc", lambda m: next(formulas, ""), "\n".join(out))


def elements(pages: DataFrame) -> DataFrame:
    """(article_id, kind, seq): numbered elements of every page's last fetch."""
    model = trained()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for page in b["html"]:
                labels = [label for _, label in label_page(page, model)]
                rows.append([labels.count(k) for k in KINDS])
            yield pd.DataFrame({"article_id": b["article_id"], "fetched_at": b["fetched_at"], "digest": b["digest"], "counts": rows})

    # Counting first, then choosing the last fetch: four numbers per page are shuffled, not its source.
    rows = pages.where(F.col("html").isNotNull() & F.col("article_id").isNotNull()).select("article_id", "fetched_at", F.sha2("html", 256).alias("digest"), "html")
    counted = rows.mapInPandas(count, "article_id long, fetched_at timestamp, digest string, counts array<int>")
    last = counted.groupBy("article_id").agg(F.max_by("counts", F.struct("fetched_at", "digest")).alias("counts"))
    each = last.select("article_id", F.posexplode("counts").alias("k", "n")).where("n > 0")
    kinds = F.array(*map(F.lit, KINDS))
    return each.select("article_id", F.get(kinds, F.col("k")).alias("kind"), F.explode(F.sequence(F.lit(1), F.col("n"))).alias("seq"))


def texts(pages: DataFrame) -> DataFrame:
    """(article_id, text) of every page's last fetch."""
    model = trained()

    def clean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"article_id": b["article_id"], "fetched_at": b["fetched_at"], "digest": b["digest"], "text": [clean_text(p, model) for p in b["html"]]})

    # cleaned first, then the last fetch: clean text is shuffled, not the page's source
    rows = pages.where(F.col("html").isNotNull() & F.col("article_id").isNotNull()).select("article_id", "fetched_at", F.sha2("html", 256).alias("digest"), "html")
    cleaned = rows.mapInPandas(clean, "article_id long, fetched_at timestamp, digest string, text string")
    return cleaned.groupBy("article_id").agg(F.max_by("text", F.struct("fetched_at", "digest")).alias("text"))
