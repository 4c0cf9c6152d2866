"""The named blocks of a source text (classes, functions and their like), found by brackets or by indentation, and what they mention."""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, field

INDENTED = ("python",)
BRACED = ("rust", "javascript", "typescript", "tsx", "jsx", "java", "go", "c", "cpp", "c-sharp", "dart", "kotlin", "swift", "scala", "php")
#: Names in capitals that are no types; words before a bracket that call nothing; words of Dart that name nothing. Fixed values.
NO_TYPES = frozenset({"Self", "None", "True", "False"})
NO_CALLS = frozenset(
    "if elif else for foreach while do switch match case when catch except try with using synchronized return yield await async not and or in is new delete throw raise assert del lambda sizeof typeof instanceof function fn func fun def class struct enum trait impl let const var where pub".split()
)
DART_RESERVED = frozenset(
    "abstract as assert async await base break case catch class const continue covariant default deferred do dynamic else enum export extends extension external factory false final finally for get hide if implements import in interface is late library mixin new null on operator part required rethrow return sealed set show static super switch sync this throw true try typedef var void when while with yield".split()
)
_SINGLE_QUOTED = ("javascript", "typescript", "tsx", "jsx", "dart", "php")
_CONTAINER = re.compile(r"(?<![\w.])(class|interface|struct|enum|trait|namespace|module|mod|object|protocol|extension|union|record|mixin)\s+(?!class\b|for\b)([A-Za-z_]\w*)")
_GO_TYPE = re.compile(r"\btype\s+([A-Za-z_]\w*)\s+(struct|interface)\b")
_IMPL = re.compile(r"\bimpl\b(?:\s*<[^{]*?>)?\s+(?:([\w:]+)(?:<[^{]*?>)?\s+for\s+)?&?([\w:]+)")
_FUNCTION = re.compile(r"\b(?:fn|func|function|fun)\b\*?\s*(?:\([^()]*\)\s*)?([A-Za-z_]\w*)\s*[<(\[]")
_ARROW = re.compile(r"\b(?:const|let|var|final)\s+([A-Za-z_]\w*)\s*(?::[^=]*)?=\s*(?:async\s*)?(?:\([^{}]*\)|\w+)\s*(?::[^=]*)?=>\s*$")
_METHOD = re.compile(r"([A-Za-z_]\w*)\s*(?:<[^<>()]*>)?\s*\((?:[^(){}]|\([^(){}]*\))*\)\s*(?:const|noexcept|override|final|async\*?|sync\*|throws\s[\w.,\s]++|->[^{}=]++|:[^{}=]++|\s++)*+$")
_CALL = re.compile(r"(?<!\w)((?:[A-Za-z_]\w*(?:\.|::|->))*)([A-Za-z_]\w*)(?:::<[^()\n]*>)?!?\s*\(")
_ARGUMENT = re.compile(r"(?<=[(,])\s*([a-z_]\w*)\s*(?=[,)])")
_PYTHON = re.compile(r"(?:async\s+)?(def|class)\s+([A-Za-z_]\w*)")
_TYPE = re.compile(r"(?<!\w)[A-Z]\w+")


@dataclass
class Block:
    """A named block: its kind and name, its text from `start` to before `end`, and its head, which ends at `body`; `parent` and the number of its place in the list that blocks() gives."""

    kind: str
    name: str
    start: int
    body: int
    end: int
    parent: int | None
    head: str = ""
    bases: list[tuple[str, str]] = field(default_factory=list)


def blanked(source: str, language: str) -> str:
    """`source` with spaces in place of comments and of what stands in quotes; line feeds stay, so all places stay."""
    if language in INDENTED:
        shape = r"#[^\n]*|(?P<q>\"\"\"|''').*?(?:(?P=q)|\Z)|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?"
    else:
        single = r"'(?:\\.|[^'\\\n])*'?" if language in _SINGLE_QUOTED else r"'(?:\\[^'\n]{1,10}|\\'|[^'\\\n])'"
        line = "" if language == "rust" else r"\n"
        shape = rf"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\{line}])*\"?|`(?:\\.|[^`\\])*`?|{single}"
    return re.sub(shape, lambda m: re.sub(r"[^\n]", " ", m[0]), source, flags=re.S)


def blocks(source: str, language: str) -> list[Block]:
    """The named blocks of `source` in the order in which they begin; none for languages that are not known. Brackets that do not match close nothing, or at the end."""
    text = blanked(source, language)
    return _indented(text) if language in INDENTED else _braced(text, language) if language in BRACED else []


def _braced(text: str, language: str) -> list[Block]:
    out: list[Block] = []
    open_: list[int | None] = []
    named: list[int] = []
    last = 0
    for m in re.finditer(r"[{};]", text):
        at = m.start()
        if m[0] == "{":
            # heads are short; what is longer is data
            found = _head(text[last:at], language) if at - last < 4_000 else None
            if found:
                kind, name, bases, lead = found
                out.append(Block(kind, name, last + lead, at, len(text), named[-1] if named else None, text[last + lead : at], bases))
                named.append(len(out) - 1)
            open_.append(len(out) - 1 if found else None)
        elif m[0] == "}" and open_:
            if (k := open_.pop()) is not None:
                out[k].end = at + 1
                named.pop()
        last = at + 1
    return out


def _head(text: str, language: str) -> tuple[str, str, list[tuple[str, str]], int] | None:
    """Kind, name, bases and where it begins, of the declaration in a block's head."""
    lead = len(text) - len(text.lstrip())
    head = text.strip()
    if language == "rust" and (m := _IMPL.search(head)):
        return "impl", m[2].rsplit("::", 1)[-1], [("IMPLEMENTS", m[1].rsplit("::", 1)[-1])] if m[1] else [], lead
    if language == "go" and (m := _GO_TYPE.search(head)):
        return m[2], m[1], [], lead
    if m := _FUNCTION.search(head):
        return "function", m[1], [], lead
    if m := _CONTAINER.search(head):
        return m[1], m[2], _bases(m[1], head[m.end() :], language), lead
    if language in ("javascript", "typescript", "tsx", "jsx", "dart") and (m := _ARROW.search(head)):
        return "function", m[1], [], lead
    if language not in ("rust", "go", "kotlin", "swift", "scala") and (m := _METHOD.search(head)) and m[1] not in NO_CALLS and not re.search(r"[=.]\s*$|\b(?:new|return)\s*$", head[: m.start()]):
        return "function", m[1], [], lead
    return None


def _bases(kind: str, rest: str, language: str) -> list[tuple[str, str]]:
    """(EXTENDS or IMPLEMENTS, name) of what a head names behind its own name."""
    while (flat := re.sub(r"<[^<>]*>|\([^()]*\)", "", rest)) != rest:
        rest = flat
    names = lambda x: [n.rsplit(".", 1)[-1].rsplit("::", 1)[-1] for n in re.findall(r"[A-Za-z_][\w.:]*", x) if n not in ("public", "private", "protected", "virtual", "where", "dyn")]
    found = [(w, n) for w, part in re.findall(r"\b(extends|implements|with)\b\s+(.*?)(?=\b(?:extends|implements|with|permits)\b|$)", rest, re.S) for n in names(part)]
    if found:
        return [("EXTENDS" if w == "extends" else "IMPLEMENTS", n) for w, n in found]
    if not (m := re.match(r"\s*:\s*([^{]*)", rest)):
        return []
    own = names(re.split(r"\bwhere\b", m[1])[0])
    every = kind in ("interface", "protocol", "trait") or language == "cpp"
    return [("EXTENDS" if every or k == 0 else "IMPLEMENTS", n) for k, n in enumerate(own)]


def _indented(text: str) -> list[Block]:
    out: list[Block] = []
    open_: list[tuple[int, int]] = []
    at, depth, end, lead, head = 0, 0, 0, None, None
    for line in text.splitlines(keepends=True):
        plain = line.strip()
        if plain and depth == 0 and head is None:
            indent = len(line) - len(line.lstrip())
            while open_ and open_[-1][1] >= indent:
                out[open_.pop()[0]].end = end
            if m := _PYTHON.match(plain):
                start = at + indent if lead is None else lead
                out.append(Block("class" if m[1] == "class" else "function", m[2], start, at, len(text), open_[-1][0] if open_ else None))
                open_.append((len(out) - 1, indent))
                head = at + indent
            lead = (at + indent if lead is None else lead) if plain.startswith("@") else None
        depth = max(0, depth + len(re.findall(r"[(\[{]", line)) - len(re.findall(r"[)\]}]", line)))
        at += len(line)
        if plain:
            end = at
        if head is not None and depth == 0:
            block = out[open_[-1][0]]
            colon = _colon(text, head, at)
            block.head, block.body, head = text[head:colon], colon, None
            inside = re.match(r"(?:async\s+)?class\s+\w+\s*(?:\[[^\]]*\])?\s*\((.*)\)\s*:", block.head, re.S)
            if block.kind == "class" and inside:
                block.bases = [("EXTENDS", b.strip().rsplit(".", 1)[-1]) for b in re.sub(r"\[[^\]]*\]", "", inside[1]).split(",") if re.fullmatch(r"\s*[A-Za-z_][\w.]*\s*", b)]
    for k, _ in open_:
        out[k].end = end
    return out


def _colon(text: str, start: int, end: int) -> int:
    """Where the head that begins at `start` ends: behind its first colon outside of brackets."""
    depth = 0
    for m in re.finditer(r"[(\[{)\]}:]", text[start:end]):
        if m[0] == ":" and depth == 0:
            return start + m.end()
        depth += 1 if m[0] in "([{" else -1 if m[0] in ")]}" else 0
    return end


def edges(source: str, language: str) -> list[tuple[int, str, str]]:
    """(number of the block, kind, name) of what the blocks of `source` mention, each once: CONTAINS, EXTENDS, IMPLEMENTS, USES_TYPE of heads, CALLS and, for Dart, REFERENCES of the innermost block around."""
    found = blocks(source, language)
    text = blanked(source, language)
    out: dict = {}
    for k, b in enumerate(found):
        if b.parent is not None:
            out[(b.parent, "CONTAINS", b.name)] = None
        out.update(dict.fromkeys((k, kind, n) for kind, n in b.bases))
        if b.kind == "function":
            own = b.head[b.head.find(b.name) + len(b.name) :]
            out.update(dict.fromkeys((k, "USES_TYPE", t) for t in _TYPE.findall(own) if t not in NO_TYPES))
    starts = [b.start for b in found]

    def around(at: int) -> int | None:
        """The innermost block whose text holds this place."""
        k = bisect_right(starts, at) - 1
        while k >= 0 and found[k].end <= at:
            k = -1 if found[k].parent is None else found[k].parent
        return k if k >= 0 else None

    for m in _CALL.finditer(text):
        k, at = around(m.start(2)), m.start(2)
        if k is not None and at < found[k].body:
            # what a head calls, as a decorator does, the block around calls; its own name is no call
            k = None if m[2] == found[k].name else found[k].parent
        if m[2] in NO_CALLS or k is None:
            continue
        before = re.search(r"([\w>\]])[\s*&]+$", text[max(0, at - 40) : at])
        word = re.search(r"(\w+)[\s*&]+$", text[max(0, at - 40) : at])
        if found[k].kind != "function" and not m[1] and before and not (word and word[1] in NO_CALLS):
            continue  # a member that is declared without a body
        out[(k, "CALLS", m[2])] = None
    if language == "dart":
        for m in _ARGUMENT.finditer(text):
            if m[1] not in DART_RESERVED and m[1].strip("_") and (k := around(m.start(1))) is not None:
                out[(k, "REFERENCES", m[1])] = None
    return list(out)


def chunks(source: str, language: str, limit: int) -> list[tuple[int, int, int | None]]:
    """(first line, line after the last, number of the block that begins first or holds the chunk) of chunks of whole lines that together are `source`, of `limit` characters at most.

    A block that fits is never cut: what is too large is taken apart at its inner blocks' borders, and only where there are none between lines. Neighbours are
    packed while they fit. A line longer than `limit` is a chunk of its own.
    """
    lines = source.splitlines(keepends=True)
    found = blocks(source, language)
    begins = [0]
    for line in lines:
        begins.append(begins[-1] + len(line))
    line_of = lambda at: bisect_right(begins, at) - 1
    size = lambda a, b: begins[b] - begins[a]
    inner: dict[int | None, list[tuple[int, int, int]]] = {}
    for k, b in enumerate(found):
        inner.setdefault(b.parent, []).append((line_of(b.start), min(len(lines), line_of(max(b.start, b.end - 1)) + 1), k))
    pieces: list[tuple[int, int, int | None]] = []
    # lines, the block they are or lie in, and whether they are that block, so that it can be taken apart
    todo: list[tuple[int, int, int | None, bool]] = [(0, len(lines), None, True)]
    while todo:
        a, b, k, whole = todo.pop()
        own = inner.get(k, []) if whole else []
        if a < b and size(a, b) <= limit and not (k is None and whole):
            pieces.append((a, b, k))
        elif not own:
            pieces += [(x, x + 1, k) for x in range(a, b)]
        else:
            at, parts = a, []
            for x, y, n in own:
                x, y = max(x, at), min(y, b)
                if x < y:
                    parts += [(at, x, k, False), (x, y, n, True)]
                    at = y
            todo += reversed([*parts, (at, b, k, False)])
    out: list[tuple[int, int, int | None]] = []
    for a, b, k in pieces:
        if out and size(out[-1][0], b) <= limit:
            first = out[-1][2]
            out[-1] = (out[-1][0], b, k if first is None else first)
        else:
            out.append((a, b, k))
    return out
