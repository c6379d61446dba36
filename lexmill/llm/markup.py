"""Problem 3: clean text from HTML, Markdown, wiki and LaTeX, with its structure kept.

A scanner finds the spans of notation: code first (nothing inside code is notation of another kind), then the signs
each notation writes in pairs or at the start of lines. Signs several notations share (list bullets, quote and number
marks, table bars, a lone #) name no notation by themselves; they are read as whatever notation the text is in.
Lengths of the lines after stripping make the line-block distribution: sums over a sliding window of lines surge where
a body begins and dive where it ends, measured against the text's own average. What lies outside the bodies and held
markup (footers, navigation, categories) is residue and dropped; structure and lines that never held markup are kept.

Result: the clean text; its blocks (kind, text), kind being text, heading, list, code, formula, table or quote; and the
notations found. Headings, list items, code and formulas are thus recognizable without any notation.

Cases: null texts give null and no notation; blank texts are returned as empty; text without markup is returned as it
stands but for white space at its ends; texts of any length are read whole; repeated rows give repeated results; other
columns are ignored. A formula keeps its source, and code its own signs; cleaning the rest again changes nothing.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import map_arrow, pick, spread

HTML, MARKDOWN, WIKI, LATEX = "html", "markdown", "wiki", "latex"
#: lines of a block, and the share of an average block from which on a block belongs to a body
WINDOW, SHARE = 3, 0.25

#: Element names of HTML.
TAGS = "a|abbr|article|aside|b|big|blockquote|body|br|button|caption|center|cite|code|col|dd|del|details|div|dl|dt|em|figcaption|figure|font|footer|form|h[1-6]|head|header|hr|html|i|iframe|img|input|ins|kbd|label|li|link|main|mark|math|meta|nav|nowiki|ol|option|p|pre|q|s|samp|script|section|select|small|span|strike|strong|style|sub|summary|sup|svg|table|tbody|td|textarea|tfoot|th|thead|title|tr|tt|u|ul|var|video"
_TAG = rf"</?(?:{TAGS})(?:[\s/][^<>]*)?>"
_ANY = re.compile(r"[<&\\$`*_#=\[\]{}|~'>\-]|^\s*\d+[.)]\s", re.M)

_HTML_TAG = re.compile(_TAG, re.I)
_DOCTYPE = re.compile(r"<!doctype[^<>]*>", re.I)
_ENTITY = re.compile(r"&(?:#\d{2,7}|#[xX][0-9a-fA-F]{2,6}|[a-zA-Z][a-zA-Z0-9]{1,31});")
#: what opens a region that reaches to its own end mark, and that end mark; \1, \2 are groups of the opening
_FENCE = re.compile(r"^(```+|~~~+)[^\n`]*\n", re.M), r"^\1[ \t]*$"
_WIKI_CODE = re.compile(r"<(nowiki|syntaxhighlight|source)\b[^<>]*>", re.I), r"</\1\s*>"
_HTML_DEAD = re.compile(r"<(script|style)\b[^<>]*>", re.I), r"</\1\s*>"
_COMMENT = re.compile(r"<!--"), r"-->"
_HTML_CODE = re.compile(r"<(pre)\b[^<>]*>", re.I), r"</\1\s*>"
_VERBATIM = re.compile(r"\\begin\{(verbatim|lstlisting|minted)\}"), r"\\end\{\1\}"
_TEX_MATH = (
    (re.compile(r"\\begin\{(equation|align|gather|multline|eqnarray|displaymath)(\*?)\}"), r"\\end\{\1\2\}"),
    (re.compile(r"\\\["), r"\\\]"),
    (re.compile(r"\$\$"), r"\$\$"),
    (re.compile(r"\\\("), r"\\\)"),
)
_TEX_INLINE = re.compile(r"(?<![\w$])\$(?=\S)([^$\n]+)(?<=\S)\$(?![\w$])")
_TEX_CMD = re.compile(r"\\(begin|end)\{[A-Za-z]+\*?\}(?:\[[^\[\]\n]*\])?(?:\{[^{}\n]*\})?|[ ~]?\\(cite[pt]?|ref|eqref|label|includegraphics|bibliography|input|usepackage|documentclass|pageref)\*?(?:\[[^\[\]\n]*\])?\{[^{}\n]*\}|\\item\b|\\[A-Za-z]+\*?(?:\[[^\[\]\n]*\])?(?=\{)|\\[%&_#${}](?!\w)|\\\\(?=\s|$)", re.M)
_TEX_HEAD = re.compile(r"\\(?:part|chapter|(?:sub){0,2}section|(?:sub)?paragraph|title)\*?(?:\[[^\[\]\n]*\])?\{((?:[^{}]|\{[^{}]*\})*)\}")

_MD_ATX = re.compile(r"^ {0,3}(#{1,6})[ \t]+(\S.*)$", re.M)
_ATX_END = re.compile(r"[ \t]+#+$")
_MD_SETEXT = re.compile(r"^(?=\S)(?!\s*[#>|*-])([^\n]+)\n(={3,}|-{3,})[ \t]*$", re.M)
_MD_CODE = re.compile(r"(?<!`)`([^`\n]+)`(?!`)")
_MD_LINK = re.compile(r"!?\[([^\[\]\n]*)\]\(\s*[^()\s]+(?:\s+\"[^\"\n]*\")?\s*\)")
_MD_BOLD = re.compile(r"\*\*(?=[^\s*])([^*\n]+)(?<=[^\s*])\*\*|(?<!\w)__(?=[^\s_])([^_\n]+)(?<=[^\s_])__(?!\w)|~~(?=\S)([^~\n]+)(?<=\S)~~")
_MD_RULE = re.compile(r"^\|?(?:[ \t]*:?-{3,}:?[ \t]*\|)+(?:[ \t]*:?-{3,}:?)?[ \t]*$", re.M)
_MD_TASK = re.compile(r"^[ \t]*[-*+][ \t]+\[[ xX]\][ \t]", re.M)

_WIKI_HEAD = re.compile(r"^(={2,6})(?!=)[ \t]*(\S(?:.*?\S)?)[ \t]*(?<!=)\1[ \t]*$", re.M)
_WIKI_LINK = re.compile(r"\[\[(?:[^\[\]|\n]*\|)?([^\[\]|\n]*)\]\]")
_WIKI_META = re.compile(r"\[\[(?:category|kategorie|file|image|datei|catégorie|categoría|categoria)\s*:[^\[\]\n]*\]\]", re.I)
_WIKI_TEMPLATE = re.compile(r"\{\{(?!\{)([^{}\n]*)\}\}")
#: characters without a pair of quote marks, so a mark that stays open is looked at only up to the next pair
_NO_PAIR = r"(?:[^\n']|'(?!'))"
_WIKI_QUOTE = re.compile(rf"'''''(?=\S)({_NO_PAIR}+)(?<=\S)'''''|'''(?=\S)((?:{_NO_PAIR}|''(?!'){_NO_PAIR}+''(?!'))+)(?<=\S)'''(?!')|(?<!')''(?=[^\s'])({_NO_PAIR}+)(?<=[^\s'])''(?!')")
_WIKI_TABLE = re.compile(r"^[ \t]*(?:\{\|.*|\|\}[ \t]*|\|-[ \t]*|\|\+.*)$", re.M)

_BULLET = re.compile(r"^[ \t]*(?:[-*+•]|\*{1,6}|\d{1,3}[.)])[ \t]+(?=\S)")


class Result:
    __slots__ = ("text", "kinds", "texts", "notations")

    def __init__(self, text: str, kinds: list[str], texts: list[str], notations: list[str]):
        self.text, self.kinds, self.texts, self.notations = text, kinds, texts, notations


def _math(inner: str) -> bool:
    """Whether what stands between two dollar signs is a formula, not a passage between two prices."""
    depth = 0
    for c in inner:
        depth += (c in "({[") - (c in ")}]")
        if depth < 0:
            return False
    return depth == 0 and any(c in inner for c in "\\^_{=") and ". " not in inner and not re.search(r"[^\W\d_]{3,} [^\W\d_]{3,}", re.sub(r"\\[A-Za-z]+", "", inner))


def paired(text: str, marks: tuple[re.Pattern, str], to_the_end: bool = False) -> list[tuple[int, int, int, int]]:
    """(from, inner from, inner to, to) of the regions between an opening mark and the next end mark for it. An end mark
    that was not found once is not sought again, so the work is linear however many marks stay open."""
    opening, end = marks
    found, at = [], 0
    ends: dict[tuple, re.Pattern | None] = {}
    while m := opening.search(text, at):
        at, key = m.end(), m.groups()
        if key not in ends:
            ends[key] = re.compile(re.sub(r"\\([12])(?!\d)", lambda g: re.escape(m.group(int(g.group(1))) or ""), end) if key else end, re.I | re.M)
        closing = ends[key] and ends[key].search(text, at)
        if closing:
            found.append((m.start(), at, closing.start(), closing.end()))
            at = closing.end()
        elif to_the_end:
            found.append((m.start(), at, len(text), len(text)))
            break
        else:
            ends[key] = None
    return found


def spans(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str, str]]]:
    """(signs, regions): spans of notation to remove, and regions (code, formula) to keep whole, each with its notation."""
    signs: list[tuple[int, int, str]] = []
    regions: list[tuple[int, int, str, str]] = []
    hidden = text

    def blank(part: str) -> str:
        return re.sub(r"[^\n]", "\x00", part)

    def take(found: list[tuple[int, int, int, int]], kind: str, notation: str) -> None:
        """Regions (from, inner from, inner to, to) are hidden from all later patterns, in one pass."""
        nonlocal hidden
        out, at = [], 0
        for lo, a, b, hi in found:
            if kind:
                signs.append((lo, a, notation))
                signs.append((b, hi, notation))
                regions.append((a, b, kind, notation))
            else:
                signs.append((lo, hi, notation))
            out += [hidden[at:lo], blank(hidden[lo:hi])]
            at = hi
        if found:
            hidden = "".join([*out, hidden[at:]])

    def single(pattern: re.Pattern, kind: str, notation: str, good=lambda inner: True) -> None:
        take([(m.start(), m.start(1), m.end(1), m.end()) for m in pattern.finditer(hidden) if good(m.group(1))], kind, notation)

    if "`" in text or "~~~" in text:
        take(paired(hidden, _FENCE, to_the_end=True), "code", MARKDOWN)
    if "<" in hidden:
        take(paired(hidden, _WIKI_CODE), "code", WIKI)
        take(paired(hidden, _COMMENT), "", HTML)
        take(paired(hidden, _HTML_DEAD), "", HTML)
        take([(m.start(), m.start(), m.end(), m.end()) for m in _DOCTYPE.finditer(hidden)], "", HTML)
        take(paired(hidden, _HTML_CODE), "code", HTML)
    if "\\" in hidden or "$" in hidden:
        take(paired(hidden, _VERBATIM), "code", LATEX)
        for marks in _TEX_MATH:
            take(paired(hidden, marks), "formula", LATEX)
        single(_TEX_INLINE, "inline", LATEX, _math)
    if "`" in hidden:
        single(_MD_CODE, "inline", MARKDOWN)
    if "<" in hidden:
        for m in _HTML_TAG.finditer(hidden):
            signs.append((m.start(), m.end(), HTML))
    if "&" in hidden:
        for m in _ENTITY.finditer(hidden):
            if html.unescape(m.group(0)) != m.group(0):
                signs.append((m.start(), m.end(), HTML))
    if "\\" in hidden:
        for m in _TEX_CMD.finditer(hidden):
            signs.append((m.start(), m.end(), LATEX))
    if "[[" in hidden:
        take([(m.start(), m.start(), m.end(), m.end()) for m in _WIKI_META.finditer(hidden)], "", WIKI)
        for m in _WIKI_LINK.finditer(hidden):
            signs.append((m.start(), m.start(1), WIKI))
            signs.append((m.end(1), m.end(), WIKI))
    if "{{" in hidden:
        for m in _WIKI_TEMPLATE.finditer(hidden):
            inner = m.group(1)
            bar = inner.rfind("|")
            keep = bar >= 0 and "=" not in inner[bar:]
            if keep:
                signs.append((m.start(), m.start(1) + bar + 1, WIKI))
                signs.append((m.end(1), m.end(), WIKI))
            else:
                signs.append((m.start(), m.end(), WIKI))
    if "''" in hidden:
        for m in _WIKI_QUOTE.finditer(hidden):
            g = next(g for g in (1, 2, 3) if m.group(g) is not None)
            signs.append((m.start(), m.start(g), WIKI))
            signs.append((m.end(g), m.end(), WIKI))
    if "==" in hidden:
        for m in _WIKI_HEAD.finditer(hidden):
            signs.append((m.start(), m.start(2), WIKI))
            signs.append((m.end(2), m.end(), WIKI))
    if "|" in hidden:
        for m in _WIKI_TABLE.finditer(hidden):
            signs.append((m.start(), m.end(), WIKI))
        for m in _MD_RULE.finditer(hidden):
            signs.append((m.start(), m.end(), MARKDOWN))
    if "](" in hidden:
        for m in _MD_LINK.finditer(hidden):
            signs.append((m.start(), m.start(1), MARKDOWN))
            signs.append((m.end(1), m.end(), MARKDOWN))
    if "**" in hidden or "__" in hidden or "~~" in hidden:
        for m in _MD_BOLD.finditer(hidden):
            g = next(g for g in (1, 2, 3) if m.group(g) is not None)
            signs.append((m.start(), m.start(g), MARKDOWN))
            signs.append((m.end(g), m.end(), MARKDOWN))
    if "\n==" in hidden or "\n--" in hidden:
        for m in _MD_SETEXT.finditer(hidden):
            signs.append((m.end(1), m.end(), MARKDOWN))
    if _MD_TASK.search(hidden):
        for m in _MD_TASK.finditer(hidden):
            signs.append((m.start(), m.end(), MARKDOWN))
    if "#" in hidden:
        wiki = any(n == WIKI for _, _, n in signs)
        for m in _MD_ATX.finditer(hidden):
            if len(m.group(1)) > 1 or not wiki:
                signs.append((m.start(), m.start(2), MARKDOWN))
                title = m.group(2).rstrip(" \t")
                end = m.start(2) + (x.start() if (x := _ATX_END.search(title)) else len(title))
                if end < m.end():
                    signs.append((end, m.end(), MARKDOWN))
            else:
                signs.append((m.start(), m.start(2), WIKI))
    return signs, regions


def notations_of(text: str | None) -> list[str]:
    if not text or not _ANY.search(text):
        return []
    signs, regions = spans(text)
    return sorted({n for _, _, n in signs} | {n for *_, n in regions})


def mask(text: str) -> str:
    """The text with notation, code and formulas blanked out, every other character in its place."""
    if not _ANY.search(text):
        return text
    signs, regions = spans(text)
    if not signs and not regions:
        return text
    out = list(text)
    for a, b, _ in signs:
        out[a:b] = [" " if c != "\n" else c for c in out[a:b]]
    for a, b, kind, _ in regions:
        out[a:b] = [" " if c != "\n" else c for c in out[a:b]]
    return "".join(out)


def _line_kind(raw: str, notations: set[str]) -> str:
    s = raw.strip()
    if not s or not notations:
        return "text"
    if HTML in notations and (m := re.match(r"<(h[1-6]|li|ul|ol|td|th|tr|table|blockquote)\b", s, re.I)):
        t = m.group(1).lower()
        return "heading" if t[0] == "h" else "list" if t in ("li", "ul", "ol") else "quote" if t == "blockquote" else "table"
    if LATEX in notations and _TEX_HEAD.match(s):
        return "heading"
    if LATEX in notations and s.startswith("\\item"):
        return "list"
    if WIKI in notations and _WIKI_HEAD.match(s):
        return "heading"
    if MARKDOWN in notations and _MD_ATX.match(s):
        return "heading"
    if WIKI in notations and (s[0] in "*#:;" or _BULLET.match(raw)):
        return "list"
    if s[0] in "|!" and (WIKI in notations or MARKDOWN in notations):
        return "table"
    if s[0] == ">" and MARKDOWN in notations:
        return "quote"
    if MARKDOWN in notations and _BULLET.match(raw):
        return "list"
    return "text"


def clean(text: str | None) -> Result | None:
    """The clean text, its blocks and its notations."""
    if text is None:
        return None
    if not _ANY.search(text):
        t = text.strip()
        return Result(t, ["text"] if t else [], [t] if t else [], [])
    signs, regions = spans(text)
    if not signs and not regions:
        t = text.strip()
        return Result(t, ["text"] if t else [], [t] if t else [], [])
    found = {n for _, _, n in signs} | {n for *_, n in regions}
    # marks of the lines survive the removal of spans: each sign is cut out, block tags break the line
    cut: list[tuple[int, int, str]] = []
    for a, b, n in signs:
        s = text[a:b]
        new = ""
        if n == HTML:
            if s.startswith("&"):
                new = html.unescape(s).replace("\xa0", " ")
            elif re.match(r"</?(?:p|div|h[1-6]|li|ul|ol|table|tr|br|blockquote|pre|section|article|header|footer|nav|hr|dd|dt|dl|body|html|head|title)\b", s, re.I):
                new = "\n\x01" if re.match(r"<h[1-6]", s, re.I) else "\n\x02" if re.match(r"<li", s, re.I) else "\n"
            elif re.match(r"</?t[dh]\b", s, re.I):
                new = " "
        elif n == LATEX and len(s) == 2 and s[0] == "\\" and s[1] in "%&_#${}":
            new = s[1]
        cut.append((a, b, new))
    blocks = sorted((a, b, k) for a, b, k, _ in regions if k != "inline")
    cut.sort()
    lines: list[tuple[str, str, bool]] = []  # kind, clean text, whether it held notation

    done = 0  # parts are stripped in their order, so cuts before them are never looked at again

    def strip_part(a: int, b: int) -> str:
        nonlocal done
        while done < len(cut) and cut[done][1] <= a and cut[done][0] < a:
            done += 1
        out, at = [], a
        for k in range(done, len(cut)):
            x, y, new = cut[k]
            if x >= b:
                break
            if y <= at and x < at:
                continue
            x, y = max(x, at), min(y, b)
            if x > at:
                out.append(text[at:x])
            out.append(new)
            at = max(at, y)
        out.append(text[at:b])
        return "".join(out)

    def passage(a: int, b: int) -> None:
        pos = a
        for raw in text[a:b].split("\n"):
            end = pos + len(raw)
            kind = _line_kind(raw, found)
            if text[end : end + 1] == "\n" and MARKDOWN in found and (m := _MD_SETEXT.match(text, pos)) and m.end() <= b:
                kind = "heading"
            kind_of = kind if not (HTML in found and raw.lstrip()[:1] == "<") or kind == "table" else "text"
            got = strip_part(pos, end)
            held = got != raw
            if LATEX in found:
                got = re.sub(r"(?<!\\)[{}]", "", got) if "{" in got or "}" in got else got
                if re.match(r"\s*%", got):
                    got = ""
            for part in got.split("\n"):
                kind = kind_of
                if part[:1] in "\x01\x02" and part:
                    kind = "heading" if part[0] == "\x01" else "list"
                    part = part[1:]
                if kind == "list":
                    part = re.sub(r"^\s*(?:[-*+#:;•]+|\d{1,3}[.)])\s+", "", part)
                elif kind == "table":
                    part = re.sub(r"^\s*[|!]+\s*|\s*\|\s*$", "", part).replace("|", " ")
                elif kind == "quote":
                    part = re.sub(r"^\s*>+\s*", "", part)
                part = re.sub(r"[ \t]+", " ", part).strip()
                if part:
                    lines.append((kind, part, held))
            pos = end + 1

    at = 0
    for a, b, k in blocks:
        if a < at:
            continue
        passage(at, a)
        inner = text[a:b]
        if k == "code":
            inner = html.unescape(re.sub(_TAG, "", inner, flags=re.I)) if HTML in found else inner
            inner = inner.strip("\n")
        if inner.strip():
            lines.append((k, inner.strip() if k == "formula" else inner, False))
        at = b
    passage(at, len(text))
    body = between_surge_and_dive([len(t) for _, t, _ in lines])
    kept = [(k, t) for (k, t, held), inside in zip(lines, body) if inside or k != "text" or not held]
    return Result("\n".join(t for _, t in kept), [k for k, _ in kept], [t for _, t in kept], sorted(found))


def between_surge_and_dive(size: list[int], window: int = WINDOW, share: float = SHARE) -> list[bool]:
    """Which lines belong to a body, by the distribution of text over blocks of `window` lines.

    A block begins at each line. The text surges at a block that holds at least `share` of what the text's blocks hold
    on average, if neither of the next blocks is empty; it dives at the first block after that which holds less.
    Lines from the surge to the last line of the last block before the dive are body; there may be several bodies.
    """
    n = len(size)
    run = [0]
    for x in size:
        run.append(run[-1] + x)
    block = [run[min(n, i + window)] - run[i] for i in range(n)]
    least = share * sum(block) / max(1, n)
    body = [False] * n
    i = 0
    while i < n:
        if block[i] >= least and block[i] and all(block[i : i + window]):
            # the block's own first lines may still be the thin ones before the body
            while size[i] * window < least and i + 1 < n:
                i += 1
            j = i
            while j + 1 < n and block[j + 1] >= least:
                j += 1
            # a block reaches over its first line: lines too thin to be text at its end are not body
            end = min(n, j + window)
            while end > j + 1 and size[end - 1] * window < least:
                end -= 1
            body[i:end] = [True] * (end - i)
            i = max(end, j + 1)
        else:
            i += 1
    return body


def clean_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", separator: str | None = None) -> DataFrame:
    """(id, clean STRING, blocks ARRAY<STRUCT<kind, text>>, notations ARRAY<STRING>). A map without a shuffle.

    With `separator`, the parts of a path are lines of their own while they are read.
    """

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = b.column(1).to_pylist()
        if separator:
            texts = [t if t is None else t.replace(separator, "\n") for t in texts]
        got = [clean(t) for t in texts]
        kind = pa.struct([("kind", pa.string()), ("text", pa.string())])
        blocks = pa.array([[{"kind": k, "text": t} for k, t in zip(g.kinds, g.texts)] if g else [] for g in got], pa.list_(kind))
        cleaned = [None if g is None else g.text.replace("\n", separator) if separator else g.text for g in got]
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(cleaned, pa.string()), blocks, pa.array([g.notations if g else [] for g in got], pa.list_(pa.string()))], [id_col, "clean", "blocks", "notations"])

    k = df.schema[id_col].dataType.simpleString()
    return map_arrow(spread(pick(df, **{"id": id_col, "text": text_col})), run, f"`{id_col}` {k}, clean string, blocks array<struct<kind:string,text:string>>, notations array<string>")
