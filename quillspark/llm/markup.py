"""Markup residue: HTML, Markdown, wiki and LaTeX notation to clean text that keeps its structure.

Site template removal comes first. The element subtrees of a field with tags are hashed with the path of
their parents, counted per host (the ISSN of the journal that delivered the field) over distinct pages, and a
subtree that recurs on a share of its host's pages, and on a least number of them, is deleted. Fields without
a host have no template: they come from no one site. What an element holds exempts it, whatever its name:
headings, code and formulas, data without a letter (line breaks, cells of numbers), and an inline element
that stands in running text.

What is left is converted. Code and formulas are set aside first and put back last, so nothing inside them
is touched: code on one line stands in back quotes, on several in a fence with its indentation, formulas
stand between dollar signs. Headings become lines beginning with #, list items lines beginning with -, tables
cells divided by |; other notation goes, its text stays. Scripts and style sheets are no text and go. An
unclosed mark loses itself only, never what follows it.

Null and empty fields have no row in the result of fields with markup and come out unchanged otherwise.
Plain signs of prose (comparisons, prices, [1], {*}, (#4), 2 * 3, a_b) are no markup. Repeated rows come
out each; an empty table gives no rows. Incomplete tags and unclosed notation count as markup.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.session import spread

_SIGNS = re.compile(r"[<>&\\`\[\]{}|~=#$*_^]")
#: Lines of lists, and rules.
_LINE = re.compile(r"(?m:^[ \t]*(?:(?:[-+•*]|\d{1,3}[.)])[ \t]+\S|-{3,}[ \t]*$))")

#: Elements of several letters, which may have attributes without a value.
ELEMENTS = (
    "abbr acronym address applet area article aside audio base basefont bdi bdo big blink blockquote body br button canvas caption center cite code col colgroup data datalist dd del details dfn dialog dir div dl dt em embed fieldset "
    "figcaption figure font footer form frame frameset h1 h2 h3 h4 h5 h6 head header hr html iframe img input ins kbd label legend li link main map mark marquee math menu meta meter nav nobr noframes noscript object ol optgroup option "
    "output param picture pre progress rp rt ruby samp script section select small source span strike strong style sub summary sup svg table tbody td template textarea tfoot th thead time title tr track tt ul var video wbr"
)
#: A tag: of any name if it is bare, closing, closed in itself or has attributes with values; `a <b and c> d` is none.
TAG = rf"</?[A-Za-z][\w:.-]*\s*/?>|</?[A-Za-z][\w:.-]*\s(?=[^<>]*(?:=|/>))[^<>]*>|</[A-Za-z][\w:.-]*\s[^<>]*>|<(?:{ELEMENTS.replace(' ', '|')})\s[^<>]*>"
#: A tag that the end of the text cut off.
CUT_TAG = rf"</?(?:[A-Za-z][\w:.-]*|[A-Za-z][\w:.-]*\s(?=[^<>]*=)[^<>]*|(?:{ELEMENTS.replace(' ', '|')})\s[^<>]*)$"

#: One alternative per notation. Each needs more than a sign that prose also has.
NOTATION = {
    "html": rf"<!--|-->|{TAG}|{CUT_TAG}|" r"<[!?][A-Za-z\[]|(?<=[\w\"'\s])/>|<(?:br|p|div|span|i|b|em|sub|sup|strong|table|tr|td|li|ul|ol|h[1-6])\b|</[A-Za-z]",
    "reference": r"&(?:#\d{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});|&(?:nbsp|amp|lt|gt|quot|[aeiouAEIOU](?:acute|grave|circ|tilde|uml)|[cC]cedil|[nN]tilde)(?![A-Za-z])|&#x?[0-9A-Fa-f]{2,6}\b",
    "latex": r"\\[A-Za-z]+|\\[\[\]()%&'`^~\"$#_{}=.,;:!|@-]|\\\\|\{\\|\$(?=[^\s$])(?:(?=[^$\n]*[\\^_{}=+])[^$\n]+|[A-Za-z])(?<=\S)\$(?!\d)|\$\$|\w[\^_]\{[^{}\n]*\}",
    "markdown": r"```|~~~|`[^`\n]+`|(?:^|(?<=\s))#{1,6}[ \t]+\S|\*\*[^\s*][^*\n]*|__[^\s_][^_\n]*__|~~[^\s~][^~\n]*~~|!?\[[^\[\]\n]+\]\([^()\s]+(?:\s\"[^\"]*\")?\)|!?\[[^\[\]\n]+\]\(https?:|(?<![\w*\\])\*[^\s*\d][^*\n]*(?<![\s*])\*(?![\w*])|(?<![\w_])_[^\s_][^_\n]*(?<![\s_])_(?![\w_])"
    r"|(?m:^[ \t]*[-*+•][ \t]+\S)|(?m:^[ \t]*\d{1,3}[.)][ \t]+\S)|(?m:^[ \t]*>[ \t]?\S)|\|[ \t]*:?-{3,}|(?m:^[ \t]*\|.*\|[ \t]*$)|(?m:^[ \t]*(?:-{3,}|\*{3,}|_{3,})[ \t]*$)",
    "wiki": r"\[\[|\]\]|\{\{|\}\}|\{\||\|\}|(?m:^\|-)|(?<=\s)\|\|(?=\s)|(?:^|(?<=\s))={2,6}[ \t]*[^=\s][^=\n]*={2,6}(?=\s|$)|'{2,5}[\w(\[][^'\n]*|(?<=\w)'{2,5}|\[https?://\S+",
}
_EACH = {k: re.compile(v) for k, v in NOTATION.items()}
#: Signs without which a notation can't be there.
_NEEDS = {k: re.compile(v) for k, v in {"html": "[<>]", "reference": "&", "latex": r"[\\$^_{]", "markdown": r"[`#*_~\[|>]", "wiki": r"[\[\]{}|=]|''"}.items()}

#: Elements that end a line, and those that hold nothing.
BLOCKS = frozenset("address article aside blockquote body center dd div dl dt fieldset figure footer form header hr li main nav ol p pre section table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_TAG = re.compile(r"<!--.*?(?:-->|$)|<(?P<end>/?)(?P<name>[A-Za-z][\w:.-]*)(?P<attr>(?:\s[^<>]*)?)(?P<void>/?)>", re.S)
_HEADING = re.compile(r"h[1-6]|(?:.*:)?title")
_NO_TEMPLATE = re.compile(r"<(?:pre|code|tt|kbd|samp|math|sub|sup|\w+:math)\b|[`$]|\\[(\[a-z]", re.I)
_LETTER = re.compile(r"[^\W\d_]")
_BARE_TAG = re.compile(r"<[^<>]*>")
_SPACE = re.compile(r"\s+")


def kinds(text: str | None) -> list[str]:
    """The notations that a text holds, sorted; empty for plain text and null."""
    if not text:
        return []
    out = []
    if _SIGNS.search(text):
        out = [k for k, needs in _NEEDS.items() if needs.search(text) and _EACH[k].search(text)]
    elif "''" in text and _EACH["wiki"].search(text):
        out = ["wiki"]
    if "markdown" not in out and ("\n" in text or not text[0].isalpha()) and _LINE.search(text):
        out.append("markdown")
    return sorted(out)


def subtrees(text: str) -> list[tuple[int, int, int]]:
    """(hash, start, end) of each element that may be template; the hash covers it and the path to it.

    Each piece of text is read once, whatever it is nested in: a closed element goes into its parent as its
    digest, with what the exemptions need to know of it."""
    out, open_at = [], []
    path: Counter = Counter()  # names of the open elements
    above = [b""]  # the path to each open element, then to what comes next, as a digest
    parts: list[tuple[bytes, bool, bool, bool]] = []  # of what is open: digest, whether it is exempt, has letters, has "="
    at = 0

    def read(start, end, tag):
        piece = text[start:end]
        if piece:
            letters = not tag and bool(_LETTER.search(_BARE_TAG.sub("", piece)))
            parts.append((_digest(_SPACE.sub(" ", piece).lower()), bool(_NO_TEMPLATE.search(piece)), letters, "=" in piece))

    def add(name, first, start, end):
        """The element made of the parts from the first on."""
        whole = _digest(b"".join(x[0] for x in parts[first:]))
        exempt, letters, equals = (any(x[k] for x in parts[first:]) for k in (1, 2, 3))
        parts[first:] = [(whole, exempt, letters, equals)]
        if exempt or _HEADING.fullmatch(name):
            return
        if not letters and not equals:
            return  # line breaks and cells of numbers; an image has a source
        if name not in BLOCKS and (_runs(text[max(0, start - 80) : start], True) or _runs(text[end : end + 80], False)):
            return
        out.append((_hash(above[-1] + whole), start, end))

    for m in _TAG.finditer(text):
        name = (m["name"] or "").lower()
        if not name:
            continue
        read(at, m.start(), False)
        first, at = len(parts), m.end()
        read(m.start(), at, True)
        if m["end"]:
            while path[name]:
                own, first, start = open_at.pop()
                above.pop()
                path[own] -= 1
                if not path[own]:
                    del path[own]
                if own == name:
                    add(name, first, start, at)
                    break
            else:
                del path[name]
        elif m["void"] or m["attr"].rstrip().endswith("/") or name in VOID:
            add(name, first, m.start(), at)
        else:
            open_at.append((name, first, m.start()))
            above.append(above[-1] if path[name] else _digest(above[-1] + name.encode()))
            path[name] += 1
    return out


def _runs(beside: str, before: bool) -> bool:
    """Whether the text beside an inline element goes on into it, without a tag between and in the same line."""
    near = re.split(r"[<>\n]", beside)[-1 if before else 0].strip()
    return bool(near) and (near[-1] if before else near[0]) not in "|•·»›/"


def _digest(x: str | bytes) -> bytes:
    return xxhash.xxh3_128_digest(x)


def _hash(x: bytes) -> int:
    return xxhash.xxh3_64_intdigest(x) - (1 << 63)


# What is set aside, in order of the text: code, then formulas. The first to open wins.
_ASIDE = re.compile(
    "|".join([
        r"(?P<f>```|~~~)(?:[\w+-]*[ \t]*\n)?(?P<fence>.*?)(?P=f)",
        r"<(?P<t>pre|code|tt|kbd|samp)\b[^<>]*>(?P<element>(?:(?!<(?:pre|code|tt|kbd|samp)\b).)*?)</(?P=t)\s*>",
        r"\\begin\{(?P<v>verbatim\*?|lstlisting|minted)\}(?:\[[^\]]*\])?(?P<verbatim>(?:(?!\\begin\{(?P=v)\}).)*?)\\end\{(?P=v)\}",
        r"(?<![\\`])`(?P<tick>[^`\n]*[^`\n\\])`",
        r"\\begin\{(?P<e>(?:equation|align|displaymath|math|eqnarray|gather|multline)\*?)\}(?P<environment>(?:(?!\\begin\{(?P=e)\}).)*?)\\end\{(?P=e)\}",
        r"(?<!\\)\\\[(?P<display>(?:(?!\\\[).)*?)\\\]|(?<!\\)\\\((?P<inline>(?:(?!\\\().)*?)\\\)|\$\$(?P<double>[^$]+)\$\$",
        r"<math\b[^<>]*>(?P<math>(?:(?!<math\b).)*?)</math\s*>",
        r"(?<!\\)\$(?=[^\s$])(?P<dollar>(?=[^$\n]*[\\^_{}=+])[^$\n]+|(?=[^\s$]*['()<>|*/-])[^\s$]+|[A-Za-z])(?<=\S)\$(?!\d)",
        r"(?P<bare>\\(?:[dt]?frac|sqrt|binom|sum|prod|int)\b(?:\[[^\]]*\])?(?:[\^_](?:\{[^{}]*\}|\w))*(?:\{[^{}]*\})*|(?<!\w)\w+[\^_]\{[^{}\n]*\})",
    ]),
    re.S | re.I,
)
_CODE = ("fence", "element", "verbatim", "tick")
_FORMULA = ("environment", "display", "inline", "double", "math", "dollar", "bare")


def _render(m: re.Match) -> str:
    """Code or a formula as it stands in clean text."""
    for name in _FORMULA:
        if (x := m[name]) is not None:
            if "<" in x and _EACH["html"].search(x):
                x = re.sub(TAG, " ", x)
            x = " ".join(html.unescape(re.sub(r"\\label\{[^{}]*\}", "", x)).split())
            return f"${x}$" if x else ""
    name = next(n for n in _CODE if m[n] is not None)
    x = m[name]
    if name == "element":
        x = html.unescape(re.sub(TAG, "", re.sub(r"<br\s*/?>", "\n", x, flags=re.I)))
    x = x.strip("\n").rstrip()
    return "" if not x.strip() else f"\n```\n{x}\n```\n" if "\n" in x else f"`{x.strip() if name != 'tick' else x}`"


def _template(m: re.Match) -> str:
    """The values of a wiki template, in brackets where it hangs on a word, as references do; its name is no text."""
    told = ", ".join(v for part in m[2].split("|")[1:] if (v := part.partition("=")[2].strip() if "=" in part else part.strip()))
    return f"{m[1]} ({told})" if m[1] and told else m[1] + told


def _tabular(m: re.Match) -> str:
    rows = re.split(r"\\\\(?:\[[^\]]*\])?|\\hline|\\(?:top|mid|bottom)rule", m[1])
    cells = [[c.strip() for c in re.split(r"(?<!\\)&", r)] for r in rows if r.strip()]
    return "\n" + "\n".join(" | ".join(["", *r, ""]).strip() for r in cells) + "\n"


_STEPS = [
    (re.compile(r"<!--|-->"), " "),
    (re.compile(r"<(script|style)\b[^<>]*>(?:(?!<\1\b).)*?</\1\s*>", re.S | re.I), " "),
    (re.compile(r"\\label\{[^{}]*\}"), ""),
    (re.compile(r"\\begin\{(?:tabular|array|longtable)\*?\}(?:\[[^\]]*\])?(?:\{[^{}]*\})*((?:(?!\\begin\{(?:tabular|array|longtable)).)*?)\\end\{(?:tabular|array|longtable)\*?\}", re.S), _tabular),
    (re.compile(r"<h([1-6])\b[^<>]*>((?:(?!<h[1-6]\b).)*?)</h\1>", re.S | re.I), r"\n# \2\n"),
    (re.compile(r"<[\w.-]+:title\b[^<>]*>((?:(?!<[\w.-]+:title\b).)*?)</[\w.-]+:title>", re.S | re.I), r"\n# \1\n"),
    (re.compile(r"\\(?:sub)*section\*?\{([^{}]*)\}"), r"\n# \1\n"),
    (re.compile(r"(?:^|(?<=\s))(={2,6})[ \t]*([^=\s][^=\n]*)\1(?=\s|$)"), lambda m: f"\n# {m[2].rstrip()}\n"),
    (re.compile(r"(?:^|(?<=\s))#{1,6}[ \t]+(?=\S)"), "\n# "),
    (re.compile(r"<li\b[^<>]*>|\\item\b(?:\[[^\]]*\])?", re.I), "\n- "),
    (re.compile(r"^[ \t]*[*+•][ \t]+(?=\S)", re.M), "- "),
    (re.compile(r"<t[dh]\b[^<>]*>", re.I), " | "),
    (re.compile(r"\{\|[^\n]*|^\|-[^\n]*|^\|\}|\|\}", re.M), ""),
    (re.compile(r"^[ \t]*(?:\|[ \t]*)?:?-{3,}:?[ \t]*(?:\|[ \t:-]*)*$", re.M), ""),
    (re.compile(r"\|\|"), "|"),
    (re.compile(r"<br\s*/?>|</?(?:%s)\b[^<>]*>" % "|".join(sorted(BLOCKS)), re.I), "\n"),
    (re.compile(rf"{TAG}|{CUT_TAG}|<[!?][A-Za-z\[][^<>]*>?", re.I), ""),
    (re.compile(r"(?<=[\w\"'\s])/>"), ""),
    (re.compile(r"\[\[(?:[^\[\]]*\|)?([^\[\]|]*)\]\]"), r"\1"),
    (re.compile(r"!?\[([^\[\]\n]+)\]\([^()\s]+(?:\s\"[^\"]*\")?\)"), r"\1"),
    (re.compile(r"\[https?://\S+[ \t]+([^\[\]\n]+)\]"), r"\1"),
    (re.compile(r"'{2,5}"), ""),
    (re.compile(r"\*\*([^\s*][^*\n]*)\*\*|(?<![\w_])__([^\s_][^_\n]*)__|~~([^\s~][^~\n]*)~~"), lambda m: m[1] or m[2] or m[3]),
    (re.compile(r"(?<![\w*\\])\*([^\s*\d][^*\n]*?)(?<![\s*])\*(?![\w*])|(?<![\w_$\\^{])_([^\s_][^_\n]*?)(?<![\s_])_(?![\w_])"), lambda m: m[1] or m[2]),
    (re.compile(r"^[ \t]*>[ \t]?", re.M), ""),
    (re.compile(r"```|~~~"), ""),
]
_ACCENTS = {"'": "\u0301", "`": "\u0300", "^": "\u0302", "~": "\u0303", '"': "\u0308", "c": "\u0327"}
_ACCENT = re.compile(r"\\(?:(['`^~\"])\s*(?:\{\\?([A-Za-z])\}|\\?([A-Za-z]))|(c)\{([A-Za-z])\})")
#: Commands that stand for a sign; Greek letters follow from their names.
SIGNS = {"pm": "±", "times": "×", "cdot": "·", "leq": "≤", "le": "≤", "geq": "≥", "ge": "≥", "neq": "≠", "approx": "≈", "infty": "∞", "rightarrow": "→", "to": "→", "degree": "°", "textdegree": "°", "ldots": "…", "dots": "…", "ss": "ß", "ae": "æ", "o": "ø", "S": "§", "copyright": "©"}
_LATEX = [
    (re.compile(r"~?\\(?:cite[tp]?|ref|eqref|label|footnotemark)\{[^{}]*\}"), ""),
    (re.compile(r"\\(?:begin|end)\{[^{}]*\}(?:\[[^\]]*\])?"), "\n"),
    (re.compile(r"\{\\(?:em|it|bf|tt|sc|rm|sf|sl)\b\s*([^{}]*)\}"), r"\1"),
]
_ARGUMENT = re.compile(r"\\[A-Za-z]+\*?\{([^{}]*)\}")
_LATEX_LAST = [
    (re.compile(r"\\([%&$#_{}])"), r"\1"),
    (re.compile(r"\\\\"), "\n"),
    (re.compile(r"(?<![\w:])\\[A-Za-z]+\*?|\\(?:newline|linebreak|newpage|par|noindent|smallskip|medskip|bigskip|hfill|quad|qquad|maketitle)\b"), ""),
    (re.compile(r"\[\[|\]\]|\{\{|\}\}"), ""),  # of wiki links and templates that were cut off
]


def _accent(m: re.Match) -> str:
    return unicodedata.normalize("NFC", (m[2] or m[3] or m[5]) + _ACCENTS[m[1] or m[4]])


def _sign(m: re.Match) -> str:
    name = m[1]
    if name in SIGNS:
        return SIGNS[name]
    kind = "CAPITAL" if name[0].isupper() else "SMALL"
    try:
        return unicodedata.lookup(f"GREEK {kind} LETTER {'LAMDA' if name.lower() == 'lambda' else name.upper().removeprefix('VAR')}")
    except KeyError:
        return m.group()


def _until_same(pattern: re.Pattern, to, text: str) -> str:
    """From the inside out, for notation that nests."""
    n = 1
    while n:
        text, n = pattern.subn(to, text)
    return text


def _without_comments(text: str) -> str:
    out, at = [], 0
    while (a := text.find("<!--", at)) >= 0 and (b := text.find("-->", a + 4)) >= 0:
        out += [text[at:a], " "]
        at = b + 3
    return "".join([*out, text[at:]])


def _convert_notation(text: str) -> str:
    if "<!--" in text:
        text = _without_comments(text)
    if "{{" in text:
        text = _until_same(_WIKI_TEMPLATE, _template, text)
    for pattern, to in _STEPS:
        text = pattern.sub(to, text)
    if "\\" in text:
        text = _ACCENT.sub(_accent, text)
        text = re.sub(r"\\([A-Za-z]+)(?![A-Za-z{])(?:\{\})?", _sign, text)
        for pattern, to in _LATEX:
            text = pattern.sub(to, text)
        text = _until_same(_ARGUMENT, r"\1", text)
    for pattern, to in _LATEX_LAST:
        text = pattern.sub(to, text)
    return html.unescape(text)


_WIKI_TEMPLATE = re.compile(r"([^\s{}|(]?)\{\{([^{}]*)\}\}")


def clean(text: str | None, template: list[tuple[int, int]] = ()) -> str | None:
    """Clean text; template: spans to delete."""
    if not text:
        return text
    outer: list[tuple[int, int]] = []
    for a, b in sorted(template, key=lambda x: (x[0], -x[1])):
        if not outer or a >= outer[-1][1]:  # those inside another go with it
            outer.append((a, b))
    for a, b in reversed(outer):
        text = text[:a] + " " + text[b:]
    if not kinds(text):
        return text
    mark = next((c for c in map(chr, range(0xFDD0, 0xFDF0)) if c not in text), "")  # characters that no text has
    held: list[str] = []

    def aside(m):
        held.append(_render(m))
        return f"{mark}{len(held) - 1}{mark}"

    def restored(m):
        piece = held[int(m[1])]
        return piece if piece[:1] == "\n" or m.group()[0] != " " else " " + piece

    for _ in range(4):  # again where tags were written as references
        if mark:
            text = _ASIDE.sub(aside, text)
        text = _convert_notation(text)
        if "<" not in text or not _EACH["html"].search(text):
            break
    text = re.sub(r"[ \t\u00a0]+", " ", text)
    text = re.sub(r" ?\n\s*\n\s*", "\n\n", re.sub(r" +\n", "\n", text))
    text = re.sub(r"(?m)^(- .*)\n\n(?=- )", r"\1\n", text).strip()
    if held:
        back = re.compile(f" ?{mark}(\\d+){mark}(?: (?=[.,;:)]))?")
        while mark in text:  # a formula may stand in code that was set aside later
            text = back.sub(restored, text)
        text = re.sub(r"\n{3,}(?=```)|(?<=```)\n{3,}", "\n\n", text).strip("\n ")
    return text


def _fields(batch):
    rec, host, page = (batch.column(k).to_pylist() for k in range(3))
    for k, field in ((3, "title"), (4, "abstract")):
        for r, h, p, text in zip(rec, host, page, batch.column(k).to_pylist()):
            if text:
                yield r, h, p, field, text


def _count(batches):
    for batch in batches:
        rows = {(h, p, x[0]) for _, h, p, _, text in _fields(batch) if "<" in text for x in subtrees(text)}
        h, p, x = zip(*rows) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(h, pa.string()), pa.array(p, pa.string()), pa.array(x, pa.int64())], names=["host", "page", "subtree"])


def _find(batches):
    for batch in batches:
        rows = [(r, field, h, text, k, [x[0] for x in subtrees(text)] if "<" in text else []) for r, h, _, field, text in _fields(batch) if (k := kinds(text))]
        cols = list(zip(*rows)) or [()] * 6
        types = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["rec_id", "field", "host", "text", "notation", "subtrees"])


def _convert(batches):
    for batch in batches:
        texts, known = batch.column(2).to_pylist(), batch.column(4).to_pylist()
        out = [clean(t, [(a, b) for h, a, b in subtrees(t) if h in k] if k else ()) for t, k in zip(texts, (set(k or ()) for k in known))]
        n = [len(k or ()) for k in known]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), batch.column(3), pa.array(n, pa.int32())], names=["rec_id", "field", "clean_text", "notation", "removed"])


def fields_with_markup(records: DataFrame, pages_at_least: int = 20, host_column: str = "issn", share: float = 0.1) -> DataFrame:
    """records(rec_id, id, title, abstract, host) -> rec_id, field, clean_text, notation, removed subtrees.

    A template stands on at least `share` of its host's pages and on pages_at_least of them."""
    src = spread(records.select("rec_id", F.coalesce(F.regexp_replace(F.col(host_column), "[^0-9A-Za-z]", ""), F.lit("")).alias("host"), F.coalesce("id", F.col("rec_id").cast("string")).alias("page"), "title", "abstract"))
    found = src.mapInArrow(_find, "rec_id long, field string, host string, text string, notation array<string>, subtrees array<long>")
    hosted = src.where("host <> ''")
    held_by = hosted.select("host", "page").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("of")).where(F.col("of") >= pages_at_least)
    met = hosted.mapInArrow(_count, "host string, page string, subtree long").distinct().groupBy("host", "subtree").agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") >= pages_at_least)
    template = met.join(held_by, "host").where(F.col("pages") >= F.col("of") * share).select("host", "subtree")
    one = found.where(F.size("subtrees") > 0).select("rec_id", "field", "host", F.explode("subtrees").alias("subtree")).join(template, ["host", "subtree"]).groupBy("rec_id", "field").agg(F.collect_set("subtree").alias("known"))
    held = found.join(one, ["rec_id", "field"], "left").select("rec_id", "field", "text", "notation", "known")
    return held.mapInArrow(_convert, "rec_id long, field string, clean_text string, notation array<string>, removed int")
