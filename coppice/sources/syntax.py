"""Callable items of Rust, Go and TypeScript files, with shape, calls and metrics. One Arrow pass, a file at a time.

A file is cut into tokens, brackets nest them, and one reader for all three languages makes a light tree whose node
kinds are the ones that markers, scores and metrics ask for. The shape of an item is its kinds in pre-order; other
parsers name more nodes, so sizes are comparable within this table, not with theirs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_CODE = r"""
(?P<skip>\s+|//[^\n]*|/\*.*?(?:\*/|\Z))
|(?P<string>b?r\#+".*?"\#+|b?"(?:\\.|[^"\\])*"|`(?:\\.|[^`\\])*`|%s)
|(?P<number>[0-9][0-9a-zA-Z_]*(?:\.[0-9][0-9a-zA-Z_]*)?)
|(?P<name>[^\W\d][\w$]*|\$[\w$]*)
|(?P<sign><<=|>>=|\.\.\.|\.\.=|===|!==|=>|->|::|:=|&&|\|\||==|!=|<=|>=|\+=|-=|\*=|/=|%%=|&=|\|=|\^=|\+\+|--|\?\?|\?\.|\.\.|<-|.)
"""
_RUST = re.compile(_CODE % r"b?'(?:\\.[^']*|[^'\\])'", re.S | re.X)
_OTHER = re.compile(_CODE % r"'(?:\\.|[^'\\\n])*'", re.S | re.X)
_CLOSE = {"(": ")", "[": "]", "{": "}"}


@dataclass
class Token:
    kind: str  # string, number, name, sign, or the opening bracket of a group
    text: str
    start: int
    end: int
    line: int
    last: int
    inner: list["Token"] = field(default_factory=list)


def tokens(text: str, lang: str) -> list[Token]:
    """Nested tokens; a group holds what is between its brackets. Brackets that don't match end where the text ends."""
    stack: list[tuple[Token | None, list[Token]]] = [(None, [])]
    line = 1
    for m in (_RUST if lang == "rust" else _OTHER).finditer(text):
        kind, s = m.lastgroup, m[0]
        if kind != "skip":
            if s in _CLOSE and kind == "sign":
                stack.append((Token(s, s, m.start(), m.end(), line, line), []))
            elif s in _CLOSE.values() and kind == "sign":
                if len(stack) > 1:
                    group, inner = stack.pop()
                    group.inner, group.end, group.last = inner, m.end(), line
                    stack[-1][1].append(group)
            else:
                stack[-1][1].append(Token(kind, s, m.start(), m.end(), line, line + s.count("\n")))
        line += s.count("\n")
    while len(stack) > 1:
        group, inner = stack.pop()
        group.inner, group.end, group.last = inner, len(text), line
        stack[-1][1].append(group)
    return stack[0][1]


@dataclass
class Node:
    kind: str
    kids: list["Node"] = field(default_factory=list)
    call: tuple[str, str | None, str] | None = None
    text: str = ""


@dataclass(frozen=True)
class Language:
    """Node kinds of a language. ``heads``: keyword -> (kind, the bodies after it: b block, c cases)."""

    heads: dict[str, str]
    member: str
    scoped: str | None
    closure: str
    cases: str
    block: str
    assign: str
    compound: str
    structural: frozenset[str]
    branching: frozenset[str]
    boundary: frozenset[str]
    words: dict[str, str]


RUST = Language(
    heads={"if": "if_expression", "match": "match_expression", "for": "for_expression", "while": "while_expression", "loop": "loop_expression"},
    member="field_expression", scoped="scoped_identifier", closure="closure_expression", cases="match_arm", block="block", assign="assignment_expression", compound="compound_assignment_expr",
    structural=frozenset({"if_expression", "match_expression", "for_expression", "while_expression", "loop_expression"}),
    branching=frozenset({"if_expression", "for_expression", "while_expression", "loop_expression", "match_arm"}),
    boundary=frozenset({"closure_expression", "function_item"}),
    words={"let": "let_declaration", "return": "return_expression", "break": "break_expression", "continue": "continue_expression"},
)
GO = Language(
    heads={"if": "if_statement", "for": "for_statement", "switch": "expression_switch_statement", "select": "select_statement"},
    member="selector_expression", scoped=None, closure="func_literal", cases="expression_case", block="block", assign="assignment_statement", compound="assignment_statement",
    structural=frozenset({"if_statement", "for_statement", "select_statement", "expression_switch_statement"}),
    branching=frozenset({"if_statement", "for_statement", "expression_case", "communication_case"}),
    boundary=frozenset({"func_literal", "function_declaration", "method_declaration"}),
    words={"return": "return_statement", "defer": "defer_statement", "go": "go_statement", "var": "var_declaration", "const": "const_declaration"},
)
TYPESCRIPT = Language(
    heads={"if": "if_statement", "for": "for_statement", "while": "while_statement", "do": "do_statement", "switch": "switch_statement", "catch": "catch_clause", "try": "try_statement", "finally": "finally_clause"},
    member="member_expression", scoped=None, closure="arrow_function", cases="switch_case", block="statement_block", assign="assignment_expression", compound="augmented_assignment_expression",
    structural=frozenset({"if_statement", "for_statement", "for_in_statement", "while_statement", "do_statement", "catch_clause", "ternary_expression", "switch_statement"}),
    branching=frozenset({"if_statement", "for_statement", "for_in_statement", "while_statement", "do_statement", "catch_clause", "ternary_expression", "switch_case"}),
    boundary=frozenset({"arrow_function", "function_expression", "function_declaration", "method_definition"}),
    words={"return": "return_statement", "throw": "throw_statement", "const": "lexical_declaration", "let": "lexical_declaration", "var": "variable_declaration", "await": "await_expression", "new": "new_expression"},
)
LANGUAGES = {"rs": ("rust", RUST), "go": ("go", GO), "ts": ("typescript", TYPESCRIPT), "tsx": ("typescript", TYPESCRIPT)}
#: Macros and methods that stop a Rust program.
PANIC_MACROS, PANIC_METHODS = ("panic", "todo", "unimplemented", "unreachable"), ("unwrap", "expect")


class Reader:
    """Turns nested tokens into nodes."""

    def __init__(self, text: str, lang: str, table: Language):
        self.text, self.lang, self.t = text, lang, table

    def nodes(self, row: list[Token]) -> list[Node]:
        out, at = [], 0
        while at < len(row):
            at = self._one(row, at, out)
        return out

    def _is(self, row: list[Token], at: int, *texts: str) -> bool:
        return 0 <= at < len(row) and row[at].text in texts and row[at].kind != "string"

    def _block(self, group: Token) -> Node:
        return Node(self.t.block, self.nodes(group.inner))

    def _one(self, row: list[Token], at: int, out: list[Node]) -> int:
        """Reads one construct at ``at`` into out; returns where the next begins."""
        tok, t = row[at], self.t
        if tok.kind == "name" and tok.text in t.heads and not self._is(row, at - 1, ".", "?."):
            return self._head(row, at, out)
        if tok.kind == "name" and (end := self._callable(row, at, out)):
            return end
        if tok.kind == "name" and tok.text in t.words and not self._is(row, at - 1, "."):
            out.append(Node(t.words[tok.text]))
            if t.words[tok.text] == "lexical_declaration":
                out[-1].kids.append(Node("variable_declarator"))
            if tok.text == "new" and at + 1 < len(row):  # what is made isn't called
                end = self._chain(row, at + 1, out[-1].kids)
                for n in _walk(out[-1].kids[:1]):
                    if n.call and self.text.startswith(n.text, row[at + 2].start if at + 2 < len(row) else 0):
                        n.kind, n.call = "constructor", None
                return end
            if tok.text in ("let", "var", "const") and self.lang != "go":
                return self._declared(row, at + 1, out)
            return at + 1
        if tok.text in ("|", "||") and tok.kind == "sign" and self.lang == "rust" and self._prefix(row, at):
            return self._closure(row, at, out)
        if tok.kind == "(" and self.lang == "typescript" and self._is(row, at + 1, "=>", ":") and (arrow := self._arrow(row, at + 1)):
            return self._arrow_body(row, arrow, out)
        if tok.kind in ("name", "string", "number", "(", "["):
            return self._chain(row, at, out)
        if tok.kind == "{":
            out.append(self._block(tok))
            return at + 1
        if tok.text in ("&&", "||"):
            out.append(Node("binary_expression", text=tok.text))
        elif tok.text == ":=":
            out.append(Node("short_var_declaration"))
        elif tok.text == "=":
            out.append(Node(t.assign))
        elif tok.text[-1:] == "=" and tok.text[0] in "+-*/%&|^<>" and tok.text not in ("<=", ">="):
            out.append(Node(t.compound))
        elif tok.text == "?" and self.lang == "typescript" and not self._is(row, at + 1, ":", ")", ","):
            out.append(Node("ternary_expression"))
        return at + 1

    def _declared(self, row: list[Token], at: int, out: list[Node]) -> int:
        """Past the pattern and type of a declaration, up to behind its =, which is no assignment."""
        stop = at
        while stop < len(row) and not self._is(row, stop, "=", ";", "of", "in") and row[stop].line <= row[at].line + 1:
            stop += 1
        out += [Node("identifier") for x in row[at:stop] if x.kind == "name" and x.text not in ("mut", "ref")]
        return stop + 1 if self._is(row, stop, "=") else max(stop, at)

    def _prefix(self, row: list[Token], at: int) -> bool:
        return at == 0 or row[at - 1].kind == "sign" and row[at - 1].text != "?" or row[at - 1].text in ("move", "return", "else", "in")

    def _head(self, row: list[Token], at: int, out: list[Node]) -> int:
        word, node = row[at].text, Node(self.t.heads[row[at].text])
        out.append(node)
        body = at + 1
        # the condition goes to the next block; in Go and Rust a literal in it can't have braces
        while body < len(row) and row[body].kind != "{" and not self._is(row, body, ";") | (self.lang == "typescript" and body > at + 1 and row[at + 1].kind == "("):
            body += 1
        if self.lang == "go":
            while body < len(row) and row[body].kind != "{":
                body += 1
        if word == "for" and self.lang == "typescript" and any(x.text in ("of", "in") and x.kind == "name" for g in row[at + 1 : body] if g.kind == "(" for x in g.inner):
            node.kind = "for_in_statement"
        node.kids += self.nodes(row[at + 1 : body])
        if body < len(row) and row[body].kind == "{":
            cases = word in ("match", "switch", "select")
            node.kids.append(Node(self.t.block, self._cases(row[body].inner, word)) if cases else self._block(row[body]))
            body += 1
        elif self.lang == "typescript" and word not in ("do", "try", "finally"):  # a lone statement
            end = body
            while end < len(row) and not self._is(row, end, ";", "else"):
                end += 1
            node.kids += self.nodes(row[body:end])
            body = end + 1 if self._is(row, end, ";") else end
        if word == "if" and self._is(row, body, "else"):
            if self._is(row, body + 1, "if"):
                return self._head(row, body + 1, node.kids)
            if body + 1 < len(row) and row[body + 1].kind == "{":
                node.kids.append(self._block(row[body + 1]))
                return body + 2
            return body + 1
        if word == "do" and self._is(row, body, "while"):
            return body + 2
        return body

    def _cases(self, row: list[Token], word: str) -> list[Node]:
        if word == "match":
            out, at = [], 0
            while at < len(row):
                arrow = next((k for k in range(at, len(row)) if self._is(row, k, "=>")), None)
                if arrow is None:
                    break
                end = arrow + 2 if arrow + 1 < len(row) and row[arrow + 1].kind == "{" else next((k for k in range(arrow + 1, len(row)) if self._is(row, k, ",")), len(row))
                out.append(Node("match_arm", [Node("match_pattern"), *self.nodes(row[arrow + 1 : end])]))
                at = end + 1 if self._is(row, end, ",") else end
            return out
        starts = [k for k, x in enumerate(row) if x.kind == "name" and x.text in ("case", "default")]
        out = []
        for k, start in enumerate(starts):
            end = starts[k + 1] if k + 1 < len(starts) else len(row)
            kind = "default_case" if row[start].text == "default" else "communication_case" if word == "select" else self.t.cases
            out.append(Node(kind, self.nodes(row[start + 1 : end])))
        return out

    def _callable(self, row: list[Token], at: int, out: list[Node]) -> int | None:
        """A nested function: a node that metrics don't enter."""
        word = {"rust": "fn", "go": "func", "typescript": "function"}[self.lang]
        if not self._is(row, at, word):
            arrow = self._arrow(row, at + 1) if self.lang == "typescript" else None
            return self._arrow_body(row, arrow, out) if arrow and not self._is(row, at, "async") else None
        body = next((k for k in range(at, len(row)) if row[k].kind == "{"), None)
        if body is None:
            return None
        named = at + 1 < len(row) and row[at + 1].kind == "name"
        kind = {"rust": "function_item", "go": "func_literal", "typescript": "function_declaration" if named else "function_expression"}[self.lang]
        out.append(Node(kind, [self._block(row[body])]))
        return body + 1

    def _arrow(self, row: list[Token], at: int) -> int | None:
        """Where the => of an arrow function is whose parameters end before ``at``; a return type may stand between."""
        if self._is(row, at, "=>"):
            return at
        if self._is(row, at, ":"):
            k = at + 1
            while k < len(row) and (row[k].kind in ("name", "[") or row[k].text in ("<", ">", ".", "|")):
                k += 1
            return k if self._is(row, k, "=>") else None
        return None

    def _arrow_body(self, row: list[Token], arrow: int, out: list[Node]) -> int:
        end = arrow + 2 if arrow + 1 < len(row) and row[arrow + 1].kind == "{" else next((k for k in range(arrow + 1, len(row)) if self._is(row, k, ",", ";")), len(row))
        body = [self._block(row[arrow + 1])] if end == arrow + 2 and row[arrow + 1].kind == "{" else self.nodes(row[arrow + 1 : end])
        out.append(Node("arrow_function", body))
        return end

    def _closure(self, row: list[Token], at: int, out: list[Node]) -> int:
        start = at + 1
        if row[at].text == "|":
            start = next((k for k in range(at + 1, len(row)) if self._is(row, k, "|")), at) + 1
        if self._is(row, start, "->"):
            start = next((k for k in range(start, len(row)) if row[k].kind == "{"), len(row))
        if start < len(row) and row[start].kind == "{":
            out.append(Node("closure_expression", [self._block(row[start])]))
            return start + 1
        end = next((k for k in range(start, len(row)) if self._is(row, k, ",", ";")), len(row))
        out.append(Node("closure_expression", self.nodes(row[start:end])))
        return end

    def _chain(self, row: list[Token], at: int, out: list[Node]) -> int:
        """A name or value with all that is applied to it: members, paths, calls, indices, ? and macros."""
        tok, t = row[at], self.t
        kinds = {"name": "identifier", "string": "string_literal", "number": "integer_literal", "(": "parenthesized_expression", "[": "array_expression"}
        node = Node(kinds[tok.kind], self.nodes(tok.inner))
        name, syntax, split, at = (tok.text if tok.kind == "name" else None), "identifier", tok.start, at + 1
        start = tok.start
        while at < len(row):
            x = row[at]
            if x.kind == "sign" and x.text in (".", "?.", "::") and at + 1 < len(row):
                nxt = row[at + 1]
                if x.text == "::" and nxt.text == "<":  # turbofish
                    depth, k = 0, at + 1
                    while k < len(row):
                        depth += {"<": 1, ">": -1, "<<": 2, ">>": -2}.get(row[k].text, 0)
                        k += 1
                        if depth <= 0:
                            break
                    at = k
                    continue
                if nxt.text == "await" and self.lang == "rust":
                    node, at, name = Node("await_expression", [node]), at + 2, None
                    continue
                if nxt.kind not in ("name", "number"):
                    break
                scoped = x.text == "::"
                node = Node((t.scoped or t.member) if scoped else t.member, [node, Node("identifier")])
                name, syntax, split, at = nxt.text, "scoped" if scoped else "field", x.start, at + 2
            elif x.kind == "(" and (x.line == row[at - 1].last or self.lang != "go"):
                qualifier = None if syntax == "identifier" else re.sub(r"::<.*>$", "", self.text[start:split].rstrip(), flags=re.S)
                call = (name, qualifier, syntax) if name else None
                node = Node("call_expression", [node, Node("arguments", self.nodes(x.inner))], call, self.text[x.start : x.end])
                name, at = None, at + 1
            elif x.kind == "[" and x.line == row[at - 1].last:
                node, name, at = Node("index_expression", [node, *self.nodes(x.inner)]), None, at + 1
            elif x.text == "?" and self.lang == "rust":
                node, name, at = Node("try_expression", [node]), None, at + 1
            elif x.text == "!" and self.lang == "rust" and at + 1 < len(row) and row[at + 1].kind in _CLOSE and name:
                node, name, at = Node("macro_invocation", [node, Node("token_tree")], text=self.text[start : row[at + 1].end]), None, at + 2
            elif x.kind == "{" and self.lang == "rust" and tok.kind == "name" and name and name[0].isupper() and at > 0:
                kids = [Node("field_initializer")] * sum(self._is(x.inner, k, ":") for k in range(len(x.inner)))
                node, name, at = Node("struct_expression", [node, *kids, *self.nodes(x.inner)]), None, at + 1
            else:
                break
        out.append(node)
        return at


def _walk(nodes: list[Node], skip: frozenset[str] = frozenset()) -> Iterator[Node]:
    for n in nodes:
        if n.kind not in skip:
            yield n
            yield from _walk(n.kids, skip)


def _cognitive(nodes: list[Node], t: Language, depth: int = 0) -> int:
    total = 0
    for n in nodes:
        if n.kind in t.boundary:
            continue
        structural = n.kind in t.structural
        total += (1 + depth if structural else 0) + (n.kind == "binary_expression")
        total += _cognitive(n.kids, t, depth + structural)
    return total


def measure(body: list[Node], lang: str, t: Language) -> dict[str, int]:
    own = list(_walk(body, t.boundary))
    empty = sum(n.kind == "match_expression" and not any(a.kind == "match_arm" for k in n.kids for a in k.kids) for n in own)
    cyclomatic = 1 + sum(n.kind in t.branching or n.kind == "binary_expression" for n in own) + empty
    if lang == "rust":
        panics = sum(n.kind == "macro_invocation" and n.text.split("!")[0] in PANIC_MACROS for n in own) + sum(bool(n.call) and n.call[2] == "field" and n.call[0] in PANIC_METHODS for n in own)
    elif lang == "go":
        panics = sum(bool(n.call) and n.call[:2] == ("panic", None) for n in own)
    else:
        panics = sum(n.kind == "throw_statement" for n in own)
    return {"cyclomatic": cyclomatic, "cognitive": _cognitive(body, t), "panics": panics}


_BINARY = re.compile(r'env!\("CARGO_BIN_EXE_(.*?)"\)')


def invocations(body: list[Node]) -> list[str]:
    """Names of the package's own binaries that a Rust item runs."""
    out = []
    for n in _walk(body):
        if n.call and n.call[0] == "new" and n.call[1] and (n.call[1] == "Command" or n.call[1].endswith("::Command")) and (m := _BINARY.search(n.text)):
            out.append(m[1])
    return out


def module_path(path: str, lang: str) -> list[str]:
    """Folders below the first src and the file's stem; lib, main and mod (index in TypeScript) say nothing."""
    parts = path.split("/")
    if lang == "go":
        stem = parts[-1].rsplit(".", 1)[0]
        return parts[:-1] + ([stem] if stem != "main" or len(parts) == 1 else [])
    parts = parts[parts.index("src") + 1 :] if "src" in parts else parts
    if not parts:
        return []
    stem = parts[-1].rsplit(".", 1)[0]
    return parts[:-1] + ([] if stem in (("lib", "main", "mod") if lang == "rust" else ("index",)) else [stem])


def _commas(row: list[Token]) -> list[list[Token]]:
    """Parts between commas; commas inside <...> don't count."""
    out, depth = [[]], 0
    for x in row:
        depth += {"<": 1, ">": -1}.get(x.text, 0) if x.kind == "sign" else 0
        if x.text == "," and x.kind == "sign" and depth <= 0:
            out.append([])
        else:
            out[-1].append(x)
    return [p for p in out if p]


def _flat(row: list[Token]) -> list[str]:
    return [w for x in row for w in ([x.text] if x.kind == "name" else _flat(x.inner))]


def parameters(row: list[Token], lang: str) -> tuple[int, int, int]:
    """Parameters, and how many of them are booleans and plain strings."""
    parts = _commas(row)
    n = yes = plain = waiting = 0
    for p in parts:
        colon = next((k for k, x in enumerate(p) if x.text == ":" and x.kind == "sign"), None)
        if lang == "rust":
            n += 1
            words = [] if colon is None else _flat(p[colon + 1 :])
            head = next((w for w in words if w not in ("mut", "dyn", "impl")), None)
            generic = any(x.text == "<" for x in p)
            last = words[-1] if words and not generic else head
            yes += last == "bool" and not generic
            plain += (last in ("str", "String") and not generic) or ("Cow" in words and any(w in ("str", "String") for w in words))
        elif lang == "go":
            n, waiting = n + 1, waiting + 1
            words = _flat(p)
            if len(p) > 1:  # names before share this type
                yes += waiting * ("bool" in words[1:])
                plain += waiting * ("string" in words[1:])
                waiting = 0
        else:
            n += 1
            words = [] if colon is None else _flat(p[colon + 1 :])
            yes += any(w in ("boolean", "Boolean") for w in words)
            plain += any(w in ("string", "String") for w in words)
    return n, yes, plain


class Items:
    """Finds the items of one file."""

    def __init__(self, path: str, text: str):
        self.path, self.text, self.lines = path, text, text.split("\n")
        self.lang, self.t = LANGUAGES[path.rsplit(".", 1)[-1]]
        self.reader = Reader(text, self.lang, self.t)
        self.out: list[dict] = []
        top = tokens(text, self.lang)
        self.exported = self._exports(top) if self.lang == "typescript" else set()
        {"rust": self._rust, "go": self._go, "typescript": self._typescript}[self.lang](top, [], [], False)
        self.imports = imports(top, text, self.lang)

    def add(self, name: str, kind: str, first: Token, body: Token, params: list[Token], mods: list[str], owner: list[str], public: bool, visible: bool, test: bool, nodes: list[Node] | None = None) -> None:
        nodes = [self.reader._block(body)] if nodes is None else nodes
        own = module_path(self.path, self.lang) + mods
        whole = list(_walk(nodes))
        head = {"rust": "function_item", "go": "method_declaration" if kind == "method" else "function_declaration", "typescript": "method_definition" if kind == "method" else "function_declaration"}[self.lang]
        shape = [head, "identifier", "parameters", *["parameter"] * len(_commas(params)), *(n.kind for n in whole)]
        counts = dict(zip(("params", "bool_params", "string_params"), parameters(params, self.lang), strict=True))
        qualified = "::".join([*own, *owner, name])
        self.out.append({
            "path": self.path, "lang": self.lang, "stable_id": f"{self.path}:{qualified}:{first.line}", "name": name, "qualified_name": qualified, "module_path": own, "container_path": owner, "kind": kind,
            "start_line": first.line, "end_line": body.last, "public": public, "root_visible": visible, "is_test": test, "shape": shape, "nodes": len(shape),
            "calls": [dict(zip(("name", "qualifier", "syntax"), n.call, strict=True)) for n in whole if n.call], "invocations": invocations(nodes) if self.lang == "rust" else [],
            **counts, **measure(nodes, self.lang, self.t),
        })

    def _tested(self, line: int) -> bool:
        """Whether an attribute right above the line marks a test; comments and blank lines between don't matter."""
        for raw in reversed(self.lines[: line - 1]):
            s = raw.strip()
            if s.startswith("#["):
                if s.endswith("]") and re.fullmatch(r"(.*::)?test", s[2:-1].split("(")[0].strip()):
                    return True
            elif s and not s.startswith(("//", "/*", "*")):
                return False
        return False

    def _rust(self, row: list[Token], mods: list[str], owner: list[str], method: bool) -> None:
        at = 0
        while at < len(row):
            x = row[at]
            if x.kind == "name" and x.text in ("mod", "impl", "trait", "fn"):
                body = next((k for k in range(at, len(row)) if row[k].kind == "{" or row[k].text == ";"), None)
                if body is None:
                    break
                group = row[body]
                if x.text == "fn" and at + 1 < len(row) and row[at + 1].kind == "name" and group.kind == "{":
                    start = self._modifiers(row, at)
                    seen = [t.text for t in row[start:at] if t.kind == "name"]
                    bare = "pub" in seen and not (start + 1 < at and row[start + 1].kind == "(")
                    params = next((t.inner for t in row[at:body] if t.kind == "("), [])
                    self.add(row[at + 1].text, "method" if method else "function", row[start], group, params, mods, owner, bare, "pub" in seen, self._tested(row[start].line))
                    self._rust(group.inner, mods, owner, False)
                elif group.kind == "{" and x.text == "mod":
                    self._rust(group.inner, [*mods, row[at + 1].text], owner, False)
                elif group.kind == "{" and x.text == "impl":
                    self._rust(group.inner, mods, [*owner, self._impl_type(row, at, body)], True)
                elif group.kind == "{":
                    self._rust(group.inner, mods, owner, False)
                at = body + 1
            else:
                if x.kind in _CLOSE:
                    self._rust(x.inner, mods, owner, False)
                at += 1

    def _modifiers(self, row: list[Token], at: int) -> int:
        """Where the item's own words begin: pub (and its place), const, async, unsafe, extern."""
        start = at
        while start > 0 and (row[start - 1].text in ("pub", "const", "async", "unsafe", "extern", "default") or row[start - 1].kind == "string" or row[start - 1].kind == "(" and start > 1 and row[start - 2].text == "pub"):
            start -= 1
        return start

    def _impl_type(self, row: list[Token], at: int, body: int) -> str:
        k = at + 1
        if row[k].text == "<":
            depth = 0
            while k < body:
                depth += {"<": 1, ">": -1, ">>": -2}.get(row[k].text, 0)
                k += 1
                if depth <= 0:
                    break
        last = next((j for j in range(body - 1, k - 1, -1) if row[j].text == "for" and row[j].kind == "name"), None)
        k = k if last is None else last + 1
        end = next((j for j in range(k, body) if row[j].text == "where" and row[j].kind == "name"), body)
        return self.text[row[k].start : row[end - 1].end]

    def _go(self, row: list[Token], mods: list[str], owner: list[str], method: bool) -> None:
        at = 0
        while at < len(row):
            if row[at].kind == "name" and row[at].text == "func" and at + 1 < len(row):
                receiver = row[at + 1] if row[at + 1].kind == "(" else None
                name = at + 2 if receiver else at + 1
                body = next((k for k in range(name, len(row)) if row[k].kind == "{"), None)
                if name < len(row) and row[name].kind == "name" and body is not None:
                    types = [w for w in _flat(receiver.inner)] if receiver else []
                    params = next((t.inner for t in row[name:body] if t.kind == "("), [])
                    n = row[name].text
                    test = self.path.rsplit("/", 1)[-1].endswith("_test.go") and n.startswith("Test")
                    own = [types[1] if len(types) > 1 else types[0]] if types else []
                    self.add(n, "method" if receiver else "function", row[at], row[body], params, [], own, n[0].isupper(), n[0].isupper(), test)
                    at = body
            at += 1

    def _exports(self, row: list[Token]) -> set[str]:
        """Names in export {...} lists."""
        return {p[0].text for k, x in enumerate(row[:-1]) if x.text == "export" and row[k + 1].kind == "{" for p in _commas(row[k + 1].inner) if p[0].kind == "name"}

    def _typescript(self, row: list[Token], mods: list[str], owner: list[str], exported: bool) -> None:
        test = bool(re.search(r"\.(test|spec)\.tsx?$", self.path))
        at, mark = 0, False
        while at < len(row):
            x = row[at]
            if x.text == "export":
                mark = True
            elif x.text in (";",) or x.kind == "{":
                if x.kind == "{":
                    self._typescript(x.inner, mods, [], exported or mark)
                mark = False
            elif x.kind == "name" and x.text == "function" and at + 1 < len(row) and row[at + 1].kind == "name":
                body = next((k for k in range(at, len(row)) if row[k].kind == "{"), None)
                if body is None:
                    break
                n, params = row[at + 1].text, next((t.inner for t in row[at:body] if t.kind == "("), [])
                public = exported or mark or n in self.exported
                self.add(n, "function", row[at - 1] if at and row[at - 1].text == "async" else x, row[body], params, [], [], public, public, test)
                self._typescript(row[body].inner, mods, [], exported or mark)
                at, mark = body, False
            elif x.kind == "name" and x.text == "class" and at + 1 < len(row):
                body = next((k for k in range(at, len(row)) if row[k].kind == "{"), None)
                if body is None:
                    break
                self._methods(row[body].inner, row[at + 1].text, exported or mark, test)
                at, mark = body, False
            elif x.kind == "name" and x.text in ("const", "let", "var"):
                at = self._variable(row, at, exported or mark, test)
                continue
            at += 1

    def _variable(self, row: list[Token], at: int, exported: bool, test: bool) -> int:
        eq = next((k for k in range(at, len(row)) if row[k].text in ("=", ";") and row[k].kind == "sign"), None)
        if eq is None or row[eq].text == ";" or at + 1 >= len(row) or row[at + 1].kind != "name":
            return at + 1
        k = eq + 2 if eq + 1 < len(row) and row[eq + 1].text == "async" else eq + 1
        if k >= len(row):
            return at + 1
        name, public = row[at + 1].text, exported or row[at + 1].text in self.exported
        if row[k].text == "function":
            body = next((j for j in range(k, len(row)) if row[j].kind == "{"), None)
            if body is not None:
                self.add(name, "function", row[at + 1], row[body], next((t.inner for t in row[k:body] if t.kind == "("), []), [], [], public, public, test)
                return body + 1
        arrow = self.reader._arrow(row, k + 1)
        if arrow and row[k].kind in ("(", "name"):
            found: list[Node] = []
            end = self.reader._arrow_body(row, arrow, found)
            last = row[min(end, len(row)) - 1]
            self.add(name, "function", row[at + 1], last, row[k].inner if row[k].kind == "(" else [row[k]], [], [], public, public, test, found[0].kids)
            if last.kind == "{":
                self._typescript(last.inner, [], [], exported)
            return end
        return at + 1

    def _methods(self, row: list[Token], owner: str, exported: bool, test: bool) -> None:
        for k in range(1, len(row) - 1):
            if row[k].kind == "(" and row[k - 1].kind == "name":
                j = k + 1
                if row[j].text == ":":
                    while j < len(row) and row[j].kind != "{" and row[j].text != ";":
                        j += 1
                if j < len(row) and row[j].kind == "{":
                    first = k - 1
                    while first > 0 and row[first - 1].text in ("async", "static", "public", "private", "protected", "get", "set", "readonly", "override", "*"):
                        first -= 1
                    hidden = any(t.text in ("private", "protected") for t in row[first:k])
                    self.add(row[k - 1].text, "method", row[first], row[j], row[k].inner, [], [owner], exported and not hidden, exported and not hidden, test)


def imports(top: list[Token], text: str, lang: str) -> list[dict]:
    """(target, alias) of a file's imports, flattened."""
    out: list[tuple[str, str | None]] = []

    def tree(row: list[Token], prefix: str) -> None:
        for p in _commas(row):
            alias = p[-1].text if len(p) > 2 and p[-2].text == "as" else None
            p = p[:-2] if alias else p
            if p and p[-1].kind == "{":
                tree(p[-1].inner, prefix + text[p[0].start : p[-1].start].strip() if len(p) > 1 else prefix)
            elif p:
                one = "".join(x.text for x in p)
                out.append(((prefix + one) if one != "self" else prefix.removesuffix("::"), alias))

    def use(row: list[Token]) -> None:
        for k, x in enumerate(row):
            if x.kind == "name" and x.text == "use" and not (k and row[k - 1].text == "."):
                end = next((j for j in range(k, len(row)) if row[j].text == ";"), len(row))
                tree(row[k + 1 : end], "")
            elif x.kind == "{":
                use(x.inner)

    if lang == "rust":
        use(top)
    for k, x in enumerate(top):
        if lang != "rust" and x.kind == "name" and x.text in ("import", "export") and k + 1 < len(top):
            if lang == "go":
                rows = top[k + 1].inner if top[k + 1].kind == "(" else top[k + 1 : k + 3]
                for j, s in enumerate(rows):
                    if s.kind == "string":
                        before = rows[j - 1] if j and rows[j - 1].line == s.line and rows[j - 1].kind in ("name", "sign") else None
                        out.append((s.text.strip('"`'), before.text if before else None))
            else:
                end = next((j for j in range(k + 1, len(top)) if top[j].text == ";" or top[j].text in ("import", "export", "const", "function")), len(top))
                found = [s for s in top[k + 1 : end] if s.kind == "string"]
                if found and (x.text == "import" or any(t.text == "from" for t in top[k:end])):
                    out.append((found[-1].text.strip("'\""), None))
    return [{"target": t, "alias": a} for t, a in out]


#: Rust items that end at a semicolon, and those that end at it or at their block.
_TO_SIGN, _TO_BLOCK = ("const", "static", "type", "use"), ("fn", "struct", "enum", "union", "trait", "mod", "impl")


def rust_surface(row: list[Token], inside_impl: bool = False) -> tuple[int, int]:
    """(public, internal) items of a file, a module or an impl: every kind of item counts, functions among them."""
    public = internal = at = 0
    while at < len(row):
        start, open_to_all = at, False
        while at < len(row) and (row[at].text in ("#", "!") or row[at].kind == "[" and at and row[at - 1].text in ("#", "!")):
            at += 1  # attributes
        if at < len(row) and row[at].text == "pub":
            open_to_all = not (at + 1 < len(row) and row[at + 1].kind == "(")
            at += 1 if open_to_all else 2
        while at + 1 < len(row) and (row[at].text in ("async", "unsafe", "default", "extern") or row[at].text == "const" and row[at + 1].text in ("fn", "unsafe", "async", "extern") or row[at].kind == "string"):
            if row[at].text == "extern" and row[at + 1].text == "crate":
                break
            at += 1
        if at >= len(row):
            break
        word = row[at].text if row[at].kind == "name" else row[at].kind
        to_sign = word in _TO_SIGN or word == "extern"
        end = next((k for k in range(at, len(row)) if row[k].text == ";" or not to_sign and row[k].kind == "{"), len(row) - 1)
        if word == "impl":
            p, i = rust_surface(row[end].inner, True) if row[end].kind == "{" else (0, 0)
            public, internal = public + p, internal + i
        elif word in _TO_SIGN + _TO_BLOCK or word == "extern":
            if not inside_impl or word in ("fn", "const", "type"):
                public, internal = public + open_to_all, internal + (not open_to_all)
            if word == "mod" and row[end].kind == "{":
                p, i = rust_surface(row[end].inner)
                public, internal = public + p, internal + i
        elif word == "{" and at > start and not inside_impl:
            internal += 1  # foreign items
        elif at + 1 < len(row) and row[at + 1].text == "!" and not inside_impl:
            internal += 1  # a macro
        at = end + 1
    return public, internal


def surface_of(path: str, text: str) -> tuple[int, int]:
    """(public, internal) items of a text in the language of its path: all kinds in Rust, what can be called in Go and TypeScript."""
    if path.endswith(".rs"):
        return rust_surface(tokens(text, "rust"))
    found = Items(path, text).out
    shown = sum(i["public"] for i in found)
    return shown, len(found) - shown


def surfaces(texts: DataFrame, key: str) -> DataFrame:
    """(key, public_items, internal_items) of each row of (key, path, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [surface_of(p, t or "") for p, t in zip(b["path"].to_pylist(), b["text"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b[key], pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64())], names=[key, "public_items", "internal_items"])

    known = F.substring_index("path", ".", -1).isin(*LANGUAGES)
    return texts.where(known).select(key, "path", "text").mapInArrow(run, f"{key} {dict(texts.dtypes)[key]}, public_items long, internal_items long")


ITEM_SCHEMA = (
    "path string, lang string, stable_id string, name string, qualified_name string, module_path array<string>, container_path array<string>, kind string, start_line int, end_line int, public boolean, root_visible boolean, "
    "is_test boolean, shape array<string>, nodes int, calls array<struct<name:string,qualifier:string,syntax:string>>, invocations array<string>, params int, bool_params int, string_params int, cyclomatic int, cognitive int, panics int"
)
_S, _I, _B = pa.string(), pa.int32(), pa.bool_()
_ITEM = pa.schema([
    ("path", _S), ("lang", _S), ("stable_id", _S), ("name", _S), ("qualified_name", _S), ("module_path", pa.list_(_S)), ("container_path", pa.list_(_S)), ("kind", _S), ("start_line", _I), ("end_line", _I), ("public", _B), ("root_visible", _B),
    ("is_test", _B), ("shape", pa.list_(_S)), ("nodes", _I), ("calls", pa.list_(pa.struct([("name", _S), ("qualifier", _S), ("syntax", _S)]))), ("invocations", pa.list_(_S)), ("params", _I), ("bool_params", _I), ("string_params", _I), ("cyclomatic", _I), ("cognitive", _I), ("panics", _I),
])
_IMPORT = pa.schema([("path", _S), ("target", _S), ("alias", _S)])


def _parsed(files: DataFrame, schema: str, arrow: pa.Schema, rows_of) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, text in zip(b["path"].to_pylist(), b["text"].to_pylist(), strict=True):
                if rows := rows_of(path, text or ""):
                    yield pa.RecordBatch.from_pylist(rows, arrow)

    known = F.substring_index("path", ".", -1).isin(*LANGUAGES)
    return files.where(F.col("path").isNotNull() & known).select("path", "text").mapInArrow(run, schema)


def items(files: DataFrame) -> DataFrame:
    """The callable items of (path, text); null and empty texts have none, nor have files of other languages."""
    return _parsed(files, ITEM_SCHEMA, _ITEM, lambda path, text: Items(path, text).out)


def file_imports(files: DataFrame) -> DataFrame:
    """(path, target, alias) of each import of (path, text)."""
    return _parsed(files, "path string, target string, alias string", _IMPORT, lambda path, text: [{"path": path, **r} for r in Items(path, text).imports])
