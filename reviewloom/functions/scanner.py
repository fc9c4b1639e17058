"""One pass over a TypeScript or JavaScript source: its tokens, and what they declare, call and name.

A lexer tells strings, templates, regular expressions and remarks apart and pairs brackets on a
stack. A walk over the tokens then marks declarations, calls, types, parameters, branches, imports and
exports. Both are linear: brackets are jumped over by their pairs, and nothing is tried twice. It is no
compiler: markup between tags is read as code, and nothing is resolved.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

_STRING = r"'[^'\\\n]*(?:\\[\s\S][^'\\\n]*)*'?|\"[^\"\\\n]*(?:\\[\s\S][^\"\\\n]*)*\"?"
_SIGNS = r"=>|\.\.\.|\?\.(?!\d)|\?\?=?|&&=?|\|\|=?|[=!]==?|\*\*=?|\+\+|--|[-+*%&|^]=|<=|[{}()\[\];,.?:<>+\-*%&|^!~=@]"
_TOKEN = re.compile(
    rf"(?P<space>\s+)|(?P<remark>//[^\n]*|/\*[\s\S]*?(?:\*/|\Z))|(?P<word>#?(?:[^\W\d]|\$)[\w$]*)|(?P<number>\d[\w.]*)|(?P<string>{_STRING})|(?P<tick>`)|(?P<sign>{_SIGNS})|(?P<slash>/)|(?P<other>[\s\S])"
)
_REGEX = re.compile(r"/(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/\w*")
_TEMPLATE = re.compile(r"[^`\\$]*(?:(?:\\[\s\S]|\$(?!\{))[^`\\$]*)*")
_CLOSES = {")": "(", "]": "[", "}": "{"}

_CONTROL = {"if", "for", "while", "switch", "catch", "with"}
_OPERATORS = {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "do", "else", "instanceof", "yield", "await", "extends", "default", "export"}
_RESERVED = _CONTROL | _OPERATORS - {"of"} | {
    "break", "class", "const", "continue", "debugger", "enum", "false", "finally", "function", "import", "let", "null", "super", "this", "true", "try", "var",
}
_TYPE_WORDS = {"any", "unknown", "never", "void", "string", "number", "boolean", "bigint", "symbol", "object", "undefined", "null", "this", "true", "false"}
_TYPE_SIGNS = {"keyof", "readonly", "unique", "asserts", "abstract", "new"}
_MEMBER = {"public", "private", "protected", "static", "async", "override", "readonly", "abstract", "declare", "accessor", "get", "set"}
_BEFORE = {"export", "default", "declare", "async", "abstract"}
_GOES_ON = {
    ".", "?.", "(", "[", ",", "?", ":", "=>", "=", "==", "===", "!=", "!==", "<", ">", "<=", "+", "-", "*", "/", "%", "**", "&", "|", "^", "&&", "||", "??",
    "+=", "-=", "*=", "%=", "&=", "|=", "^=", "&&=", "||=", "??=", "**=", "instanceof", "in", "as", "satisfies",
}
#: Signs that may stand between < and > in types.
_IN_TYPES = {",", ".", "|", "&", "?", ":", "=>", "=", "-", "..."}

#: A mark: what it is, of which kind; names; lines and offsets (of characters, the end excluded); how many
#: brackets are open there; counts of parameters.
MARKS = "mark string, kind string, name string, local string, module string, line int, end_line int, start int, end int, depth int, required int, total int, rest boolean"
TOKENS = "at int, kind string, text string, line int, depth int, start int, end int"


class Source:
    """The tokens of a text, without its remarks, and the pairs of its brackets."""

    def __init__(self, text: str) -> None:
        self.whole = text
        self.breaks = [m.start() for m in re.finditer("\n", text)]
        self.kind: list[str] = []
        self.text: list[str] = []
        self.start: list[int] = []
        self.end: list[int] = []
        self.up: list[int] = []
        self.depth: list[int] = []
        self.mate: dict[int, int] = {}
        self.angle: dict[int, int] = {}
        self.remarks: list[tuple[int, int]] = []
        self._lex()
        self.n = len(self.text)
        for i, t in enumerate(self.text):
            if t in ("(", "[", "{", "${") and self.kind[i] == "sign":
                self.mate.setdefault(i, self.n - 1)

    def line(self, offset: int) -> int:
        return bisect_right(self.breaks, offset - 1) + 1

    def _put(self, kind: str, text: str, start: int, up: int, depth: int) -> int:
        self.kind.append(kind)
        self.text.append(text)
        self.start.append(start)
        self.end.append(start + len(text))
        self.up.append(up)
        self.depth.append(depth)
        return len(self.text) - 1

    def _regex_may_start(self, at: int) -> bool:
        if not self.text:
            return True
        kind, text = self.kind[-1], self.text[-1]
        if kind == "word":
            return text in _OPERATORS
        if kind != "sign":
            return False
        if text == ")":
            opener = self.mate.get(len(self.text) - 1, 0)
            return opener > 0 and self.text[opener - 1] in _CONTROL
        if text == "}":
            return "\n" in self.whole[self.end[-1] : at]
        return text not in ("]", "++", "--")

    def _lex(self) -> None:
        whole, at, size = self.whole, 0, len(self.whole)
        # openers that wait, each with the < that may open type arguments within it
        stack: list[tuple[int, list[int]]] = [(-1, [])]

        def template(first: int, at: int) -> int:
            """A part of a template, to its end or to what stands in it; where reading goes on."""
            end = _TEMPLATE.match(whole, at).end()
            if whole.startswith("${", end):
                if end > first:
                    self._put("template", whole[first:end], first, stack[-1][0], len(stack) - 1)
                stack.append((self._put("sign", "${", end, stack[-1][0], len(stack) - 1), []))
                return end + 2
            end = min(size, end + 1)
            if end == first:
                return end
            self._put("template", whole[first:end], first, stack[-1][0], len(stack) - 1)
            return end

        while at < size:
            found = _TOKEN.match(whole, at)
            kind, text, end = found.lastgroup, found.group(), found.end()
            if kind == "space":
                at = end
                continue
            if kind == "remark":
                self.remarks.append((at, end))
                at = end
                continue
            if kind == "tick":
                at = template(at, at + 1)
                continue
            if kind == "slash":
                regex = _REGEX.match(whole, at) if self._regex_may_start(at) else None
                kind, text, end = ("regex", regex.group(), regex.end()) if regex else ("sign", "/", end)
            opener, pending = stack[-1]
            if kind == "sign" and text in _CLOSES:
                wanted = "${" if text == "}" and opener >= 0 and self.text[opener] == "${" else _CLOSES[text]
                if opener >= 0 and self.text[opener] == wanted:
                    stack.pop()
                    i = self._put("sign", text, at, stack[-1][0], len(stack) - 1)
                    self.mate[opener], self.mate[i] = i, opener
                    at = template(end, end) if wanted == "${" else end
                    continue
            i = self._put(kind, text, at, opener, len(stack) - 1)
            if kind == "sign":
                if text in ("(", "[", "{"):
                    stack.append((i, []))
                elif text == "<":
                    pending.append(i)
                elif text == ">":
                    if pending:
                        low = pending.pop()
                        self.angle[low], self.angle[i] = i, low
                elif text not in _IN_TYPES:
                    pending.clear()
            elif kind in ("regex", "other"):
                pending.clear()
            at = end


class Walk:
    """Marks of a source."""

    def __init__(self, source: Source) -> None:
        self.s = source
        self.text, self.kind, self.mate, self.n = source.text, source.kind, source.mate, source.n
        #: What a brace holds: block, object, class, members, names; what a parenthesis is: params, call, control, group.
        self.brace: dict[int, str] = {}
        self.paren: dict[int, str] = {}
        self.types: set[int] = set()
        self.heritage: set[int] = set()
        self.scopes: list[tuple[str, int | None, int, int]] = []
        self.calls: list[tuple[str, int]] = []
        self.sites: list[tuple[str, bool, int, int]] = []
        self.parameters: list[int] = []
        self.guards: list[int] = []
        self.found: list[tuple] = []
        #: Equal signs of declarations.
        self.equals: set[int] = set()
        self._walk()

    # -- reading tokens

    def at(self, i: int) -> str:
        return self.text[i] if 0 <= i < self.n else ""

    def is_word(self, i: int) -> bool:
        return 0 <= i < self.n and self.kind[i] == "word"

    def is_name(self, i: int) -> bool:
        return self.is_word(i) and self.text[i] not in _RESERVED

    def broken(self, i: int) -> bool:
        """Whether a line ends before token i."""
        return i > 0 and "\n" in self.s.whole[self.s.end[i - 1] : self.s.start[i]]

    def is_operand(self, i: int) -> bool:
        """Whether an expression may end with token i."""
        if self.kind[i] == "word":
            is_type = self.text[i] == "void" and self.at(i - 1) in (":", "|", "<", "=>")
            return is_type or self.text[i] not in _OPERATORS or self.at(i - 1) in (".", "?.")
        return self.kind[i] != "sign" or self.text[i] in (")", "]", "}", "++", "--")

    def frame(self, i: int) -> str:
        up = self.s.up[i]
        return "block" if up < 0 else self.brace.get(up, "") if self.text[up] == "{" else "other"

    def starts(self, i: int) -> bool:
        """Whether a statement starts with token i."""
        if self.frame(i) != "block":
            return False
        if i == 0 or i - 1 == self.s.up[i] or self.text[i - 1] in (";", "}"):
            return True
        if self.text[i - 1] == ")" and self.paren.get(self.mate.get(i - 1, -1)) == "control":
            return True
        if self.text[i - 1] == ":" and self._is_label(i - 1):
            return True
        return self.broken(i) and self.is_operand(i - 1)

    def _is_label(self, i: int) -> bool:
        for k in range(i - 1, max(i - 20, -1), -1):
            if self.text[k] in (";", "{", "}", "?", "("):
                return False
            if self.text[k] in ("case", "default"):
                return True
        return False

    def first_of(self, i: int, more: tuple[str, ...] = ()) -> int:
        """The first of the modifiers and decorators before token i."""
        while i > 0:
            if self.is_word(i - 1) and self.text[i - 1] in _BEFORE.union(more):
                i -= 1
                continue
            k = self.mate.get(i - 1, 0) - 1 if self.text[i - 1] == ")" else i - 1
            while k > 0 and self.is_word(k) and self.text[k - 1] == ".":
                k -= 2
            if k > 0 and self.is_word(k) and self.text[k - 1] == "@":
                i = k - 1
                continue
            return i
        return i

    def expression_end(self, i: int) -> int:
        """The last token of an expression statement that goes on with token i, its semicolon included."""
        while True:
            i = self.mate[i] if self.kind[i] == "sign" and self.text[i] in ("(", "[", "{", "${") else i
            if i + 1 >= self.n:
                return self.n - 1
            after = self.text[i + 1] if self.kind[i + 1] != "string" else ""
            if after == ";":
                return i + 1
            if after in (")", "]", "}") and self.kind[i + 1] == "sign":
                return i
            if self.broken(i + 1) and self.is_operand(i) and after not in _GOES_ON and self.kind[i + 1] != "template":
                return i
            i += 1

    def statement_end(self, i: int, ends: dict[int, int]) -> int:
        """The last token of the statement that starts with token i; ``ends`` knows those of later branches."""
        while i < self.n:
            t = self.text[i] if self.kind[i] in ("word", "sign") else ""
            if t == "{":
                return self.mate[i]
            if t == "if":
                return ends.get(i, i)
            if t in ("for", "while", "with"):
                head = i + 2 if self.at(i + 1) == "await" else i + 1
                if self.at(head) != "(":
                    return self.expression_end(i)
                i = self.mate[head] + 1
                continue
            if t == "switch" and self.at(i + 1) == "(":
                body = self.mate[i + 1] + 1
                return self.mate.get(body, body) if self.at(body) == "{" else body - 1
            if t == "try" and self.at(i + 1) == "{":
                end = self.mate[i + 1]
                if self.at(end + 1) == "catch":
                    body = self.mate[end + 2] + 1 if self.at(end + 2) == "(" else end + 2
                    end = self.mate.get(body, end)
                if self.at(end + 1) == "finally":
                    end = self.mate.get(end + 2, end)
                return end
            if t == "do":
                end = self.mate[i + 1] if self.at(i + 1) == "{" else self.expression_end(i + 1)
                return self.expression_end(end + 1) if self.at(end + 1) == "while" else end
            return self.expression_end(i)
        return self.n - 1

    # -- types, parameters, members

    def type_end(self, i: int, deep: int = 0) -> int:
        """The token after the type that starts with token i; names of types in it are marked."""
        asks = 0
        while i < self.n:
            t = self.text[i]
            if self.kind[i] == "word":
                if t in _TYPE_SIGNS:
                    i += 1
                    continue
                if t == "infer":
                    i += 2
                elif t == "typeof" or self.at(i + 1) == ".":
                    i += t == "typeof"
                    while self.is_word(i) and self.at(i + 1) == ".":
                        i += 2
                    i += 1
                else:
                    if t not in _TYPE_WORDS and t not in _RESERVED and self.at(i + 1) != "is":
                        self.types.add(i)
                    i += 1
                if self.at(i) == "<" and i in self.s.angle:
                    i = self.type_list(i, self.s.angle[i], deep)
            elif t == "(":
                close = self.mate[i]
                if self.at(close + 1) == "=>":
                    self.params(i, deep + 1)
                    i = close + 2
                    continue
                if deep < 40:
                    self.type_end(i + 1, deep + 1)
                self.paren[i] = "group"
                i = close + 1
            elif t == "<" and i in self.s.angle:
                i = self.type_list(i, self.s.angle[i], deep)
                continue
            elif t == "{":
                self.members(i, deep + 1)
                i = self.mate[i] + 1
            elif t == "[":
                i = self.type_list(i, self.mate[i], deep)
            elif self.kind[i] in ("string", "number", "template"):
                i += 1
            elif t in ("|", "&", "-"):
                i += 1
                continue
            else:
                return i
            while self.at(i) == "[" and not self.broken(i):
                if self.mate[i] > i + 1 and deep < 40:
                    self.type_end(i + 1, deep + 1)
                i = self.mate[i] + 1
            t = self.at(i)
            if t in ("|", "&", "is", "extends"):
                asks += t == "extends"
            elif not (asks and t in ("?", ":")):
                return i
            i += 1
        return self.n

    def type_list(self, i: int, close: int, deep: int) -> int:
        """Types between two brackets, with names, defaults and bounds; the token after them."""
        j = i + 1
        while j < close and deep < 40:
            if self.at(j) in (",", "...", "=", "?", ":", "const", "in", "out", "extends"):
                j += 1
            elif self.is_word(j) and self.at(j + 1) in (":", "?") and self.text[i] == "[":
                j += 2
            elif self.is_word(j) and self.at(j + 1) in ("extends", "=") and self.text[i] == "<":
                # a parameter of a declaration, not a reference
                j += 2
            else:
                j = max(j + 1, self.type_end(j, deep + 1))
        return close + 1

    def type_parameters(self, i: int) -> int:
        """The token after the type parameters of a declaration, if token i opens some."""
        if self.at(i) != "<" or i not in self.s.angle:
            return i
        close, own, j = self.s.angle[i], set(), i + 1
        while j < close:
            if self.is_word(j) and self.text[j - 1] in ("<", ",", "const", "in", "out") and self.at(j + 1) in (",", ">", "extends", "="):
                own.add(j)
            j = self.mate[j] + 1 if self.text[j] in ("(", "[", "{") else self.s.angle.get(j, j) + 1 if self.text[j] == "<" else j + 1
        after = self.type_list(i, close, 0)
        self.types -= own
        return after

    def params(self, i: int, deep: int = 0) -> tuple[int, int, bool]:
        """Marks a list of parameters; how many must be given, how many there are, whether the last takes the rest."""
        self.paren[i] = "params"
        close, j = self.mate[i], i + 1
        required = total = 0
        rest = False
        while j < close:
            is_open = False
            first = j
            while j < close and self.at(j) != ",":
                t = self.text[j] if self.kind[j] in ("sign", "word") else ""
                if t == "...":
                    rest = is_open = True
                elif t == "?" and j > first:
                    is_open = True
                elif t == "=":
                    is_open = True
                    while j < close and self.at(j) != ",":
                        j = self.mate[j] + 1 if self.text[j] in ("(", "[", "{", "${") and self.kind[j] == "sign" else j + 1
                    break
                if t == ":" and deep < 40:
                    j = max(j + 1, self.type_end(j + 1, deep + 1))
                else:
                    j = self.mate[j] + 1 if t in ("(", "[", "{", "${") else j + 1
            if j > first and self.text[first] != "this":
                total += 1
                required += not is_open
            j += 1
        return required, total, rest

    def members(self, i: int, deep: int = 0) -> None:
        """Members of an interface or of a type in braces."""
        self.brace[i] = "members"
        close, j = self.mate[i], i + 1
        while j < close and deep < 40:
            t = self.text[j]
            if t == "<" and j in self.s.angle:
                j = self.type_list(j, self.s.angle[j], deep)
            elif t == "(":
                self.params(j, deep)
                j = self.mate[j] + 1
            elif t == "[":
                j = self.mate[j] + 1
            elif t == ":":
                j = max(j + 1, self.type_end(j + 1, deep))
            else:
                j += 1

    def header(self, i: int) -> tuple[int, int | None, tuple[int, int, bool] | None]:
        """From the token after a function's name: its last token, its body's brace if any, its parameters."""
        i = self.type_parameters(i)
        if self.at(i) != "(":
            return i - 1, None, None
        counts = self.params(i)
        i = self.mate[i] + 1
        if self.at(i) == ":":
            i = self.type_end(i + 1)
        if self.at(i) == "{":
            self.brace[i] = "block"
            return self.mate[i], i, counts
        return (i if self.at(i) == ";" else i - 1), None, counts

    def class_body(self, i: int) -> None:
        self.brace[i] = "class"
        close, j = self.mate[i], i + 1
        while j < close:
            first, special = j, False
            while self.at(j) == "@":
                j += 2
                while self.at(j) == ".":
                    j += 2
                if self.at(j) == "(":
                    j = self.mate[j] + 1
            while self.is_word(j) and self.text[j] in _MEMBER and self.at(j + 1) not in ("(", "=", ":", ";", "?", "!", "<", "}"):
                special = special or self.text[j] in ("get", "set")
                j += 1
            if self.at(j) == "*":
                j += 1
            if j >= close:
                break
            if self.at(j) == "{":
                self.brace[j] = "block"
                j = self.mate[j] + 1
                continue
            if self.kind[j] not in ("word", "string", "number") and self.text[j] != "[":
                j += 1
                continue
            name, name_end = j, self.mate[j] if self.text[j] == "[" else j
            j = name_end + 1
            while self.at(j) in ("?", "!"):
                j += 1
            if self.at(j) == "(" or (self.at(j) == "<" and j in self.s.angle):
                end, _, _ = self.header(j)
                if self.text[name] != "constructor" and not special:
                    self.scopes.append(("method", name, first, end))
                j = end + 1
                continue
            if self.at(j) == ":":
                j = self.type_end(j + 1)
            if self.at(j) == "=" and j + 1 < close:
                j = self.expression_end(j + 1) + 1

    def object_body(self, i: int) -> None:
        close, j = self.mate[i], i + 1
        while j < close:
            first, special = j, False
            while self.is_word(j) and self.text[j] in ("async", "get", "set") and self.at(j + 1) not in ("(", ":", ",", "=", "}"):
                special = special or self.text[j] != "async"
                j += 1
            if self.at(j) == "*":
                j += 1
            name = j
            if j < close and (self.kind[j] in ("word", "string", "number") or self.text[j] == "["):
                j = (self.mate[j] if self.text[j] == "[" else j) + 1
                if (self.at(j) == "(" or (self.at(j) == "<" and j in self.s.angle)) and self.text[name] not in _CONTROL:
                    opener = self.s.angle[j] + 1 if self.text[j] == "<" else j
                    after = self.at(self.mate[opener] + 1) if self.at(opener) == "(" else ""
                    if after in ("{", ":"):
                        end, body, _ = self.header(j)
                        if body is not None and not special:
                            self.scopes.append(("method", name, first, end))
                        j = end + 1
            while j < close and not (self.text[j] == "," and self.kind[j] == "sign"):
                j = self.mate[j] + 1 if self.kind[j] == "sign" and self.text[j] in ("(", "[", "{", "${") else j + 1
            j += 1

    # -- the walk

    def _walk(self) -> None:
        param_until = -1
        i = 0
        while i < self.n:
            t = self.text[i]
            if self.kind[i] == "word":
                self._word(i, t)
                if i < param_until and t not in _RESERVED and t not in _TYPE_WORDS - {"undefined"} and t not in _MEMBER:
                    self.parameters.append(i)
                elif self.at(i + 1) == "=>" and t not in _RESERVED and i not in self.types:
                    self.parameters.append(i)
            elif self.kind[i] == "sign":
                if t == "=":
                    self._assignment(i)
                elif t == "(":
                    if i not in self.paren:
                        self._parenthesis(i)
                    if self.paren[i] == "params":
                        param_until = max(param_until, self.mate[i])
                elif t == "{":
                    if i not in self.brace:
                        self.brace[i] = self._brace_kind(i)
                        if self.brace[i] == "object":
                            self.object_body(i)
            i += 1
        ends: dict[int, int] = {}
        for i in reversed(self.guards):
            end = self.statement_end(self.mate[i + 1] + 1, ends)
            if self.at(end + 1) == "else":
                end = self.statement_end(end + 2, ends)
            ends[i] = min(end, self.n - 1)
        self.ends = ends

    def _brace_kind(self, i: int) -> str:
        before = self.at(i - 1) if i else ";"
        if before in (";", "{", "}", ")", "=>", "else", "do", "try", "finally", "catch"):
            return "block"
        if before == ":" and self._is_label(i - 1):
            return "block"
        if self.is_word(i - 1) and (self.at(i - 2) in ("namespace", "module", "declare") or before == "static"):
            return "block"
        return "block" if self.starts(i) else "object"

    def _parenthesis(self, i: int) -> None:
        before, close = i - 1, self.mate[i]
        if self.at(before) == ">" and before in self.s.angle:
            before = self.s.angle[before] - 1
        if self.at(before) == "?.":
            before -= 1
        t = self.at(before)
        is_arrow = self.at(close + 1) == "=>"
        if self.is_word(before) and t in _CONTROL or (t == "await" and self.at(before - 1) == "for"):
            self.paren[i] = "control"
        elif is_arrow and (t == "async" or not (self.is_name(before) and not self.broken(i))):
            self.params(i)
        elif self.is_word(before) and (t not in _RESERVED or t in ("super", "import", "this") or self.at(before - 1) in (".", "?.")):
            self._call(i, before)
        elif t in (")", "]") and before == i - 1 and not self.broken(i) and self.paren.get(self.mate.get(before, -1)) != "control":
            self.paren[i] = "call"
            if t == "]":
                self._site(i, i)
        elif self.at(close + 1) == ":" and t != "?" and t != "case" and self._is_typed_arrow(close + 2):
            self.params(i)
        else:
            self.paren[i] = "group"
        if before < i - 1 and self.paren[i] in ("call", "params") and self.at(i - 1) == ">":
            (self.type_list if self.paren[i] == "call" else lambda a, b, c: self.type_parameters(a))(self.s.angle[i - 1], i - 1, 0)

    def _is_typed_arrow(self, i: int) -> bool:
        kept = set(self.types)
        end = self.type_end(i)
        if self.at(end) == "=>":
            return True
        self.types = kept
        return False

    def _call(self, i: int, callee: int) -> None:
        """A call or construction by a name: who is called, and whether by a path of names."""
        self.paren[i] = "call"
        if self.at(callee) == "super" or self.at(callee) == "import" and self.at(callee - 1) not in (".", "?."):
            return
        if self.at(callee - 1) not in (".", "?.") and self.text[callee] not in _RESERVED:
            self.calls.append(("new" if self.at(callee - 1) == "new" else "call", callee))
        self._site(i, callee + 1)

    def _site(self, i: int, k: int) -> None:
        """The path of names that ends before token k and is called by the parenthesis i; ``a["b"]`` is a.b."""
        names: list[str] = []
        while True:
            low = self.mate.get(k - 1, k)
            if self.is_word(k - 1):
                k -= 1
                names.append(self.text[k])
                if self.at(k - 1) not in (".", "?."):
                    break
                k -= 1
            elif self.at(k - 1) == "]" and low == k - 3 and self.kind[k - 2] == "string":
                names.append(self.text[k - 2][1:-1])
                k = low
            else:
                return
        if names[-1] not in _RESERVED or names[-1] == "this":
            self.sites.append((".".join(reversed(names)), self.at(k - 1) == "new", k, i))

    def arguments(self, i: int) -> int:
        """How many arguments a call gives."""
        close, j, n = self.mate[i], i + 1, 0
        while j < close:
            n += 1
            while j < close and not (self.text[j] == "," and self.kind[j] == "sign"):
                opens = self.kind[j] == "sign" and self.text[j] in ("(", "[", "{", "${")
                j = self.mate[j] + 1 if opens else self.s.angle[j] + 1 if self.text[j] == "<" and self.s.angle.get(j, -1) > j and self.at(self.s.angle[j] + 1) == "(" else j + 1
            j += 1
        return n

    def _word(self, i: int, t: str) -> None:
        if self.at(i - 1) in (".", "?."):
            return
        up = self.s.up[i]
        if up >= 0 and self.at(i - 1) in ("(", ",") and self.at(i + 1) in (")", ",") and (t not in _RESERVED) and self.paren.get(up) == "call":
            self.calls.append(("argument", i))
        if t == "new" and self.is_name(i + 1) and self.at(i + 2) not in ("(", ".", "?.", "<"):
            self.calls.append(("new", i + 1))
        elif t in ("as", "satisfies") and i and self.is_operand(i - 1) and not self.broken(i) and self.at(i + 1) not in ("const", "", "=", ",", ")", ";"):
            if self.frame(i) not in ("names",):
                self.type_end(i + 1)
        elif t == "if" and self.at(i + 1) == "(":
            self.guards.append(i)
        elif t == "function":
            self._function(i)
        elif t == "class":
            self._class(i)
        elif t == "interface" and self.is_word(i + 1) and self.at(i + 2) in ("{", "<", "extends"):
            self._interface(i)
        elif t == "enum" and self.is_word(i + 1) and self.at(i + 2) == "{":
            self.brace[i + 2] = "members"
            first = self.first_of(i, ("const",))
            self._declared("enum", "type", i + 1, first, self.mate[i + 2])
        elif t == "type" and self.is_name(i + 1) and self.at(i + 2) in ("=", "<"):
            first = self.first_of(i)
            if self.starts(first):
                j = self.type_parameters(i + 2)
                end = self.type_end(j + 1) if self.at(j) == "=" else j
                self._declared("type", "type", i + 1, first, end if self.at(end) == ";" else end - 1)
        elif t in ("const", "let", "var") and self.at(i + 1) != "enum":
            self._variable(i)
        elif t == "import" and self.at(i + 1) not in ("(", ".") and self.starts(i):
            self._import(i)
        elif t == "export":
            self._export(i)

    def _declared(self, kind: str, exported: str, name: int | None, first: int, end: int, counts: tuple[int, int, bool] | None = None, signature: str | None = None) -> None:
        """A scope, and a contract if it is exported; ``local`` tells its signature."""
        if not self.starts(first):
            return
        self.scopes.append((kind, name, first, end))
        words = [self.text[k] for k in range(first, min(first + 12, name if name is not None else end)) if self.is_word(k)]
        own = self.text[name] if name is not None else None
        shown = signature or own
        if exported == "type":
            shown = self.source_of(first, end).split("\n")[0].strip()
        row = (shown, None, first, end, *(counts or (None, None, False)))
        if "export" in words and (called := "default" if "default" in words else own):
            self.found.append(("export", exported, called, *row))
        if own:
            self.found.append(("declaration", exported, own, *row))

    def _function(self, i: int) -> None:
        first = self.first_of(i)
        j = i + 2 if self.at(i + 1) == "*" else i + 1
        name = j if self.is_word(j) else None
        opener = self.type_parameters(j + 1 if name is not None else j)
        end, body, counts = self.header(opener)
        if counts:
            self._declared("function", "function", name, first, end, counts, self.signature(opener))

    def _class(self, i: int) -> None:
        if i and self.text[i - 1] in (".", "?.") or self.at(i + 1) in (":", "=", ",", ")"):
            return
        first = self.first_of(i)
        name = i + 1 if self.is_word(i + 1) and self.text[i + 1] not in ("extends", "implements") else None
        j = self.type_parameters(i + 2 if name is not None else i + 1)
        while j < self.n and self.text[j] not in ("{", ";", "}"):
            j = self._heritage(j)
        if self.at(j) == "{":
            self.class_body(j)
            self._declared("class", "class", name, first, self.mate[j])

    def _heritage(self, j: int) -> int:
        """Marks what token j names as a base, type arguments too; the next token."""
        if self.text[j] == "<" and j in self.s.angle:
            self.heritage.update(k for k in range(j, self.s.angle[j]) if self.is_name(k) and self.text[k] not in _TYPE_WORDS)
            return self.type_list(j, self.s.angle[j], 0)
        if self.is_word(j) and self.text[j] not in ("extends", "implements"):
            self.heritage.add(j)
        return self.mate[j] + 1 if self.text[j] in ("(", "[") else j + 1

    def _interface(self, i: int) -> None:
        first = self.first_of(i)
        j = self.type_parameters(i + 2)
        while j < self.n and self.text[j] not in ("{", ";", "}"):
            j = self._heritage(j)
        if self.at(j) == "{":
            self.members(j)
            self._declared("interface", "type", i + 1, first, self.mate[j])

    def _variable(self, i: int) -> None:
        first = self.first_of(i)
        if not self.starts(first) or not self.is_word(i + 1) and self.at(i + 1) not in ("{", "["):
            if self.is_word(i + 1) and self.at(i + 2) == ":":
                self.type_end(i + 3)
            return
        end, j, is_first = self.expression_end(i + 1), i + 1, True
        while j <= end:
            name = j
            j = self.mate[j] + 1 if self.text[j] in ("{", "[") else j + 1
            j += self.at(j) == "!"
            if self.at(j) == ":":
                j = self.type_end(j + 1)
            function = self.at(j) == "=" and self._function_at(j + 1)
            if is_first and function:
                self.scopes.append(("variable", name, first, end))
            self.equals.add(j)
            if self.at(j) == "=" and self.is_word(name) and self.s.depth[i] == 0:
                self._assigned("variable", name, j + 1)
            is_first, begun = False, j
            while j <= end and not (self.text[j] == "," and self.kind[j] == "sign"):
                j = self.mate[j] + 1 if self.kind[j] == "sign" and self.text[j] in ("(", "[", "{", "${") else j + 1
            if self.is_word(name):
                last = j - 2 if j > end and self.at(j - 1) == ";" else j - 1
                kind, counts = ("function", function) if function else ("value", (None, None, False))
                shown = self.signature(self._opener(begun + 1)) if function else self.source_of(name, last)
                row = (kind, self.text[name], shown, None, first, end, *counts)
                self.found += [(mark, *row) for mark in ("export", "declaration") if mark == "declaration" or self.at(first) == "export"]
            j += 1

    def source_of(self, first: int, last: int) -> str:
        return self.s.whole[self.s.start[first] : self.s.end[max(first, min(last, self.n - 1))]]

    def signature(self, opener: int) -> str:
        """Parameters as they stand, between commas; of an arrow without brackets its one name."""
        if self.at(opener) != "(":
            return f"({self.at(opener)})"
        parts, first, j, close = [], opener + 1, opener + 1, self.mate[opener]
        while j <= close:
            if j == close or (self.text[j] == "," and self.kind[j] == "sign"):
                if j > first:
                    parts.append(self.source_of(first, j - 1))
                first = j + 1
            j = self.mate[j] + 1 if j < close and self.kind[j] == "sign" and self.text[j] in ("(", "[", "{", "${") else self.s.angle[j] + 1 if self.s.angle.get(j, -1) > j else j + 1
        return f"({', '.join(parts)})"

    def _opener(self, j: int) -> int:
        """The first token of the parameters of the function that token j starts."""
        j += self.at(j) == "async" and self.at(j + 1) != "=>"
        if self.at(j) == "function":
            j += 1 + (self.at(j + 1) == "*")
            j += self.is_word(j)
        return self.s.angle[j] + 1 if self.at(j) == "<" and j in self.s.angle else j

    def _path(self, j: int) -> tuple[str, int] | None:
        """A path of names that token j starts, members by strings too, and the token after it."""
        if not self.is_word(j) or (self.text[j] in _RESERVED and self.text[j] != "this"):
            return None
        names, j = [self.text[j]], j + 1
        while True:
            if self.at(j) in (".", "?.") and self.is_word(j + 1):
                names.append(self.text[j + 1])
                j += 2
            elif self.at(j) == "[" and self.mate[j] == j + 2 and self.kind[j + 1] == "string":
                names.append(self.text[j + 1][1:-1])
                j += 3
            else:
                return ".".join(names), j

    def _assigned(self, kind: str, name: int, j: int) -> None:
        """A path, or an object of paths, that is given a name from token j on."""
        found = self._path(j)
        if found and (self.at(found[1]) in (",", ";", ")", "]", "}", "") or (self.broken(found[1]) and self.at(found[1]) not in _GOES_ON)):
            self.found.append(("assign", kind, self.text[name], None, found[0], name, j, None, None, None))
        if kind != "variable" or self.at(j) != "{":
            return
        close, k = self.mate[j], j + 1
        while k < close:
            key = k
            if self.kind[k] in ("word", "string", "number") and self.at(k + 1) in (":", ",", "}"):
                found = self._path(k + 2 if self.at(k + 1) == ":" else k)
                if found and (self.at(found[1]) == "," or found[1] == close) and (self.at(k + 1) == ":" or self.kind[k] == "word"):
                    member = self.text[key].strip("'\"") if self.kind[key] == "string" else self.text[key]
                    self.found.append(("assign", "member", self.text[name], member, found[0], key, key, None, None, None))
            while k < close and not (self.text[k] == "," and self.kind[k] == "sign"):
                k = self.mate[k] + 1 if self.kind[k] == "sign" and self.text[k] in ("(", "[", "{", "${") else k + 1
            k += 1

    def _assignment(self, i: int) -> None:
        """An assignment to a name, told from defaults and declarations by what stands before the name."""
        before = self.at(i - 2)
        if not self.is_name(i - 1) or i in self.equals:
            return
        opener = i - 2 >= 0 and before == "(" and self.paren.get(i - 2) in ("group", "control", "call")
        if opener or before in ("=>", "=", "&&", "||", "??", "return") or self.starts(i - 1):
            self._assigned("assignment", i - 1, i + 1)

    def _function_at(self, j: int) -> tuple[int, int, bool] | None:
        """The parameters of a function or arrow that starts with token j, if one does."""
        j += self.at(j) == "async" and self.at(j + 1) != "=>"
        if self.at(j) == "function":
            j += 1 + (self.at(j + 1) == "*")
            j += self.is_word(j)
            j = self.type_parameters(j)
            return self.params(j) if self.at(j) == "(" else None
        if self.is_word(j) and self.at(j + 1) == "=>":
            return 1, 1, False
        j = self.type_parameters(j)
        if self.at(j) != "(":
            return None
        after = self.mate[j] + 1
        if self.at(after) == "=>" or (self.at(after) == ":" and self._is_typed_arrow(after + 1)):
            return self.params(j)
        return None

    # -- modules

    def _names(self, i: int) -> list[tuple[str, str]]:
        """(name, name here) of a list of names in braces."""
        self.brace[i] = "names"
        out, part = [], []
        for k in range(i + 1, self.mate[i] + 1):
            if self.text[k] in (",", "}") and self.kind[k] == "sign":
                if len(part) > 1 and part[0] == "type" and (part[1] != "as" or len(part) == 4):
                    part = part[1:]
                if part:
                    out.append((part[0], part[-1]))
                part = []
            else:
                part.append(self.text[k].strip("'\""))
        return out

    def _from(self, i: int) -> str | None:
        return self.text[i + 1][1:-1] if self.at(i) == "from" and i + 1 < self.n and self.kind[i + 1] == "string" else None

    def _import(self, i: int) -> None:
        j = i + 1 + (self.at(i + 1) == "type" and self.at(i + 2) != "from")
        rows: list[tuple[str, str | None, str]] = []
        if self.is_name(j) and self.at(j) != "from":
            rows.append(("default", "default", self.text[j]))
            j += 1 + (self.at(j + 1) == ",")
        if self.at(j) == "*" and self.at(j + 1) == "as":
            rows.append(("namespace", None, self.at(j + 2)))
            j += 3
        elif self.at(j) == "{":
            rows += [("named", a, b) for a, b in self._names(j)]
            j = self.mate[j] + 1
        module = self._from(j)
        if module is not None:
            self.found += [("import", kind, symbol, local, module, i, j + 1, None, None, None) for kind, symbol, local in rows]

    def _export(self, i: int) -> None:
        j = i + 1 + (self.at(i + 1) == "type" and self.at(i + 2) in ("{", "*"))
        if self.at(j) == "{":
            names = self._names(j)
            end = self.mate[j]
            module = self._from(end + 1)
            mark, end = ("export", end) if module is None else ("reexport", end + 2)
            kind = "alias" if module is None else "named"
            self.found += [(mark, kind, a, b, module, i, end, None, None, None) for a, b in names]
        elif self.at(j) == "*":
            named = self.at(j + 1) == "as"
            end = j + 3 if named else j + 1
            module = self._from(end)
            if module is not None:
                row = ("namespace", None, self.text[j + 2].strip("'\"")) if named else ("star", "*", "*")
                self.found.append(("reexport", *row, module, i, end + 1, None, None, None))
        elif self.at(j) == "default" and self.at(j + 1) not in ("function", "class", "abstract", "async", "interface", "enum"):
            self.found.append(("export", "expression", "default", None, None, i, self.expression_end(j + 1) if j + 1 < self.n else j, None, None, False))

    # -- what was found

    def rows(self) -> Iterator[tuple]:
        s = self.s

        def placed(first: int, last: int) -> tuple[int, int, int, int, int]:
            last = max(first, min(last, self.n - 1))
            return s.line(s.start[first]), s.line(max(s.start[first], s.end[last] - 1)), s.start[first], s.end[last], s.depth[first]

        named = lambda mark, kind, i: (mark, kind, self.text[i], None, None, *placed(i, i), None, None, None)
        for kind, name, first, end in self.scopes:
            shown = None if name is None else s.whole[s.start[name] : s.end[self.mate[name] if self.text[name] == "[" else name]]
            yield ("scope", kind, shown, None, None, *placed(first, end), None, None, None)
        for kind, i in self.calls:
            yield named("call", kind, i)
        for i in sorted(self.types | self.heritage):
            yield named("type", "reference" if i in self.types else "heritage", i)
        for i in self.parameters:
            yield named("parameter", "name", i)
        for i in self.guards:
            yield ("guard", "if", None, None, None, *placed(i, self.ends[i]), None, None, None)
        for callee, is_new, first, opener in self.sites:
            yield ("site", "new" if is_new else "call", callee, None, None, *placed(first, self.mate[opener]), None, self.arguments(opener), None)
        for mark, kind, name, local, module, first, end, *counts in self.found:
            if mark == "declaration" and s.depth[first]:
                continue
            yield (mark, kind, name, local, module, *placed(first, end), *counts)


def marks(text: str | None) -> Iterator[tuple]:
    """The marks of a source; none of a null one."""
    if text:
        source = Source(text)
        if source.n:
            yield from Walk(source).rows()


def tokens(text: str | None) -> Iterator[tuple]:
    """All tokens of a source in order, remarks among them."""
    if not text:
        return
    source = Source(text)
    rows = [(source.start[i], source.kind[i], source.depth[i], source.end[i]) for i in range(source.n)]
    depths = {start: depth for start, _, depth, _ in rows}
    starts = sorted(depths)
    for start, end in source.remarks:
        at = bisect_right(starts, start)
        rows.append((start, "remark", depths[starts[at]] if at < len(starts) else 0, end))
    for n, (start, kind, depth, end) in enumerate(sorted(rows)):
        yield n, kind, text[start:end], source.line(start), depth, start, end


# -- indented configurations

_KEY = re.compile(r"\s*([A-Za-z0-9_.-]+)\s*:\s*(.*)$")
KEY_LINES = "line int, indent int, depth int, top_line int, top string, key string, value string, path string"


def key_lines(text: str | None, touched: list[int] | None) -> Iterator[tuple]:
    """The lines of a YAML text that give a key: how deep they stand, below which outermost key, and of touched
    lines the path of keys. Keys wait on a stack; one that stands as deep or deeper ends them, so each is put there and taken off once."""
    if not text:
        return
    asked, stack = set(touched or ()), []
    for n, line in enumerate(text.replace("\r\n", "\n").split("\n"), 1):
        found = _KEY.match(line) if line and not line.lstrip().startswith("#") else None
        if not found:
            continue
        indent = len(line) - len(line.lstrip())
        while stack and stack[-1][0] >= indent:
            stack.pop()
        stack.append((indent, n, found[1]))
        path = ".".join(key for _, _, key in stack) if n in asked else None
        yield n, indent, len(stack), stack[0][1], stack[0][2], found[1], found[2].strip(), path
