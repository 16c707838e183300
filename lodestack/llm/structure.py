"""Whether an answer ends before it is complete: a stack automaton over its structure."""

from __future__ import annotations

import re

#: Marks that tools leave where they cut, and what stands for an answer that isn't there.
CUT_MARKS = re.compile(r"(?:<snip>|\[truncated\]|\[\.\.\.\]|…|\.\.\.|\N{REPLACEMENT CHARACTER})\s*$")
PLACEHOLDER = re.compile(r"(?is)^(?:```\w*|#|//|\s)*(?:todo|n/?a|none|null|-+|\.{2,}|…|your code here|pass|tbd|placeholder|<[\w ]*>)?(?:```|\.|\s)*$")

_PIECE = re.compile(r"\"\"\"|'''|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|[\"'(){}\[\]\n]|#[^\n]*")
_STATEMENT = re.compile(r"[ \t]*(?:def|class|for|while|if|elif|else|return|import|from|try|except|with|print|raise|yield|pass|break|continue|assert|@\w|[A-Za-z_][\w.]*(?:\[[^\n]*?\])?(?:,\s*[A-Za-z_]\w*)*\s*(?:[-+*/%^|&<>]{0,2}=)(?!=)|\w+\(\)[ \t]*\r?(?:\n|$))")
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, set(")]}")
PYTHON = re.compile(r"(?m)^[ \t]*(?:def \w+\s*\(|import \w+|from [\w.]+ import|class \w+\s*[:(])|^[ \t]*(?:def|import|from|class) ?\w*$")
OTHER_CODE = re.compile(r"(?m)^[ \t]*(?:#include\s*<|public (?:class|static)|function \w+\s*\(|(?:let|const|var) \w+ ?=|package \w+|fn \w+\s*\(|func \w+\s*\(|using namespace|(?:int|void|long|double|string) \w+\s*\([^)\n]*\)\s*\{|<\?php|SELECT\b.+\bFROM\b)")
_FENCE, _FENCE_END = re.compile(r"(?m)^[ \t]*```[^\n]*(?:\n|$)"), re.compile(r"(?m)^[ \t]*```[ \t]*\r?$")
_TAG = re.compile(r"<(/?)([A-Za-z][\w-]*)(?:\s[^<>]*?)?(/?)>")
#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: An escape that lacks its digits, or a lone escape sign at the end.
_CUT_ESCAPE = re.compile(r"\\(?:u[0-9A-Fa-f]{0,3}|x[0-9A-Fa-f]?|U[0-9A-Fa-f]{0,7})?$|&(?:#\d{1,6}|#x[0-9A-Fa-f]{1,5}|amp|lt|gt|quot|nbsp)$|â€$")
_UNFINISHED = re.compile(r"(?:[-+*/%^|&<>=,.\\:@!~(\[{]|\b(?:and|or|not|in|is|if|else|for|lambda|return|import|from|as|def|class|while|with|yield|print))\s*$")


def cut_mark(text: str) -> bool:
    """Whether a text ends with the mark of a cut."""
    return bool(CUT_MARKS.search(text.rstrip()[-24:]))


def open_parts(code: str, lines: bool = True) -> str:
    """What is open at the end of the text: '' or the pending closers; where ``lines`` end statements, a bracket left open counts until the next line that starts one."""
    stack: list[str] = []
    at, end = 0, len(code)
    while at < end:
        m = _PIECE.search(code, at)
        if not m:
            break
        piece, at = m.group(), m.end()
        if piece in ('"""', "'''"):
            close = code.find(piece, at)
            if close < 0:
                return "".join(stack) + piece
            at = close + 3
        elif piece == "\n":
            if lines and stack and _STATEMENT.match(code, at):
                stack.clear()
        elif piece in _OPEN:
            stack.append(_OPEN[piece])
        elif piece in _CLOSE:
            if stack and stack[-1] == piece:
                stack.pop()
        elif piece in "\"'":
            rest = code.find("\n", at)
            if rest < 0:
                return "".join(stack) + piece
            at = rest
    return "".join(stack)


def blocks(text: str) -> list[tuple[str, str, bool]]:
    """(kind, content, closed) of a text's parts, one after the other: 'prose' outside of fences and 'code' inside, to the end of the text."""
    out, at = [], 0
    while True:
        start = _FENCE.search(text, at)
        if not start:
            out.append(("prose", text[at:], True))
            return out
        out.append(("prose", text[at : start.start()], True))
        close = _FENCE_END.search(text, start.end())
        out.append(("code", text[start.end() : close.start() if close else len(text)], bool(close)))
        if not close:
            return out
        at = close.end()


def fenced(text: str) -> tuple[str, bool, bool]:
    """(code, fence opened, fence closed): the first fenced block, or the whole text."""
    first = next((b for b in blocks(text) if b[0] == "code"), None)
    return (first[1], True, first[2]) if first else (text, False, False)


def _cut_name(code: str, name: str) -> bool:
    """Whether a text's last name occurs nowhere else in it, but as the start of other names."""
    others = set(re.findall(r"[A-Za-z_]\w*", code[: len(code) - len(name)]))
    return name not in others and any(x.startswith(name) for x in others)


def _indent(line: str) -> int:
    return len(line) - len(line.lstrip())


def code_end(code: str) -> str:
    """'complete', 'open' (breaks off inside something) or 'unterminated' (whole lines, but the program doesn't get to its end)."""
    lines = [x.rstrip() for x in code.replace("\r", "").split("\n")]
    while lines and not lines[-1].strip():
        lines.pop()
    if not lines:
        return "complete"
    k = len(lines) - 1
    while k >= 0 and (not lines[k].strip() or lines[k].lstrip().startswith("#")):
        k -= 1
    if k < 0:
        return "complete"
    last, ended = lines[k].strip(), k < len(lines) - 1
    if not ended:
        if open_parts("\n".join(lines)):
            return "open"
        if _UNFINISHED.search(last) or (re.search(r"\bif\b", last) and last.startswith("return") and not re.search(r"\belse\b", last)):
            return "open"
        name = re.search(r"[A-Za-z_]\w*$", last)
        if name and code.endswith(name.group()) and _cut_name(code, name.group()):
            return "open"
    depth = _indent(lines[k])
    if re.match(r"(?:return|raise|yield)\b|pass$", last):
        return "complete"
    if re.match(r"(?:import|from|def|class|if|for|while|elif|else|with|try|except)\b", last) or last.startswith(('"""', "'''", "@")):
        return "unterminated"
    if depth == 0:
        return "complete"
    for above in reversed(lines[:k]):
        if not above.strip() or _indent(above) > depth:
            continue
        if _indent(above) == depth:
            if re.match(r"(?:return|raise)\b", above.strip()):
                return "complete"  # the block was at its end before this statement, which never runs
            continue
        return "complete" if above.startswith("if __name__") else "unterminated"
    return "unterminated"


def prose_end(text: str) -> str:
    """'complete' (ends with a sentence's end, a heading or a label), 'open' (breaks off inside something) or 'unterminated' (no sentence's end)."""
    s = text.rstrip()
    if not s:
        return "complete"
    if _CUT_ESCAPE.search(s[-24:]):
        return "open"
    last = s.rsplit("\n", 1)[-1].strip()
    if last.startswith("#") or last.endswith(":") or re.fullmatch(r"[\"'`~=*_-]{3,}", last):
        return "complete"
    s = re.sub(r"\s#+ [^\n.!?]*$", "", s)  # a comment or heading after the text
    paragraph = re.split(r"\n\s*\n", s)[-1]
    bare = s.rstrip(" \"'”’»)*_`]}>")
    if bare and bare[-1] in ".!?;。！？":
        return "complete"
    if paragraph.count('"') % 2 or paragraph.count("“") > paragraph.count("”") or paragraph.count("«") > paragraph.count("»") or paragraph.count("(") > paragraph.count(")") or bare[-1:] in ",(-–/&":
        return "open"
    name = re.search(r"[^\W\d]\w*$", bare)
    if name and bare == s and _cut_word(bare, name.group()):
        return "open"
    return "unterminated"


def _cut_word(text: str, word: str) -> bool:
    """Whether a text's last word occurs nowhere else in it, but as the start of other words."""
    others = set(re.findall(r"[^\W\d]\w*", text[: len(text) - len(word)].lower()))
    return word.lower() not in others and any(x.startswith(word.lower()) for x in others)


def data_end(text: str) -> str:
    """How JSON-like text ends: by its brackets and quotes, which hold over line ends."""
    stack, quote, skip = [], False, False
    for c in text:
        if skip:
            skip = False
        elif quote:
            skip, quote = c == "\\", c != '"'
        elif c == '"':
            quote = True
        elif c in _OPEN:
            stack.append(_OPEN[c])
        elif c in _CLOSE and stack and stack[-1] == c:
            stack.pop()
    return "open" if stack or quote else "complete"


def markup_end(text: str) -> str:
    """How marked-up text ends: every element but the void ones must be closed, and no tag be broken."""
    if text.rfind("<") > text.rfind(">"):
        return "open"
    stack: list[str] = []
    for close, name, empty in _TAG.findall(text):
        name = name.lower()
        if close:
            if name in stack:
                while stack.pop() != name:
                    pass
        elif not empty and name not in VOID:
            stack.append(name)
    return "open" if stack else "complete"


def answer_end(text: str) -> tuple[str, bool]:
    """(state, closed): how an answer ends, by the automaton of its last part; closed: it ends with a code block that was closed explicitly."""
    if PLACEHOLDER.match(text):
        return "complete", False
    if cut_mark(text) or _CUT_ESCAPE.search(text.rstrip()[-24:]):
        return "open", False
    parts = blocks(text)
    kind, last, closed = parts[-1]
    if kind == "code":
        return "open", False
    if len(parts) > 1:
        if last.strip():
            return prose_end(last), True
        code = parts[-2][1].rstrip()
        # a closed block is whole, unless its own last line goes on
        return ("open" if not OTHER_CODE.search(code) and re.search(r"(?:[(\[{,]|[-+*/%=]|\b(?:and|or|not|in))$", code) else "complete"), True
    if PYTHON.search(text):
        return code_end(text), False
    if OTHER_CODE.search(text):
        return ("open" if open_parts(text, False) else "complete"), False
    start = text.lstrip()
    if start[:1] in ("{", "["):
        return data_end(start), False
    if _TAG.match(start):
        return markup_end(start), False
    if all(re.match(r"\s*(?:#|pass\s*$|$)", x) for x in text.split("\n")):
        return "complete", False  # nothing but comments
    return prose_end(text), False


def answer_kind(text: str) -> str:
    """What an answer ends in: 'code', 'prose' or 'other'."""
    if PYTHON.search(text):
        return "code"
    return "other" if "```" in text or OTHER_CODE.search(text) or text.lstrip()[:1] in ("{", "[", "<", "#") or PLACEHOLDER.match(text) else "prose"
