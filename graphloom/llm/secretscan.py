"""Secret scans: base patterns, and an assignment-aware lexer that follows names, literals and constants.

``scan(text)`` gives spans ``(start, end, kind)`` in code points, end exclusive. The three base kinds are the leftmost
non-overlapping matches of fixed patterns.

The lexer goes through a text once, token by token: strings (with prefixes, triple quotes and escapes), comments, names and paths
of names, operators, brackets. It reads ``name = "literal"`` in source and shell syntax, with type annotations, ``"name": "literal"``
and ``name: literal`` (also YAML blocks of several lines and values behind ``<<`` markers), ``name => literal``, keyword arguments,
``<add key="name" value="literal"/>``, ``<name>literal</name>``, ``--name value``, ``setenv("NAME", "literal")``, and the pairs of
connection strings inside a literal. Literals that are joined by ``+``, ``.``, ``..``, ``||``, ``&`` or that just follow each other
are one value. Constants go from name to name; a name is looked up in the scopes that its place is in, innermost first: braces open
a scope, and so does a function head that ends in a colon, until a line of no greater indentation. What stands in a comment is read,
but nothing is carried out of it. Names inside strings or prose are no targets.

Each literal is scored by the sensitivity of every name that it reaches. Literals over the threshold and not inside a base match
become spans of kind ``lexed``, at the literal's own place.

Null and empty texts have no spans; very long texts are scanned whole, in time proportional to their length; rows are handled one
by one, so ties, repeated rows and empty tables need no special care, and other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from functools import lru_cache
from itertools import accumulate

from pyspark.sql import DataFrame

from ._spark import by_slice, slim

KINDS = ("assign", "access", "hex", "lexed")
# Fixed patterns.
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # a maximal run of 16 or more
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: Only texts with one of these can have a name that says that its value is secret.
_STEMS = re.compile(r"pass|pwd|secret|token|key|cred|bearer|auth|signature|dsn|jwt|otp|salt|cookie|session")
_TOKEN = re.compile(
    r"""(?P<space>[ \t\r]++)|(?P<line>\n)
    |(?P<comment>//|/\*|\#|<!--|\*/|-->)
    |(?P<string>(?<![A-Za-z0-9_])(?:[fFbBrRuU]{1,2})?(?:\"{3}(?:[^"\\]|\\.|"(?!""))*+\"{3}|'{3}(?:[^'\\]|\\.|'(?!''))*+'{3})
      |(?:(?<![A-Za-z0-9_])[fFbBrRuU]{1,2})?"(?:[^"\\\n]|\\.)*+"|(?:(?<![A-Za-z0-9_])[fFbBrRuU]{1,2})?(?<![A-Za-z0-9_])'(?:[^'\\\n]|\\.)*+'|`[^`]*+`)
    |(?P<flag>(?<!\S)--?[A-Za-z][\w-]*+(?==|[ \t]))
    |(?P<tag><(?P<element>[A-Za-z_][\w.:-]*+)(?:[ \t][^<>\n]*+)?>(?P<content>[^<>\n]++)</(?P=element)>)
    |(?P<name>[A-Za-z_$][\w$]*+(?:-[A-Za-z_$][\w$]*+)*+)
    |(?P<op>:=|=>|->|::|\+=|===|==|!=|<=|>=|\|\||<<-?|\.\.|[=:+.,;&|()\[\]{}<>])
    |(?P<other>.)""",
    re.X | re.S,
)
_RAW = re.compile(r"[^\s\"'`,;{}()<>]++")
_BLOCK = re.compile(r"[|>][+-]?[ \t]*\n")
_MARKER = re.compile(r"<<-?[ \t]*[\"']?([A-Za-z_]\w*+)[\"']?[^\n]*+\n")
_TYPE = re.compile(r"[ \t]*[A-Za-z_][\w.]*+(?:[<\[][\w ,.|]*+[>\]])?[?*&]?[ \t]*(?==[^=])")
_PATH = re.compile(r"[A-Za-z_$][\w$]*+(?:(?:\.|->|::)[A-Za-z_$][\w$]*+)*+")
_SETTER = re.compile(r"(?:set|put|setenv|putenv|define|setproperty|add|header|export)\w*", re.I)
_QUOTED = re.compile(r"(?:[A-Za-z]{0,2})(\"{3}|'{3}|[\"'`])")
_WITHIN = re.compile(r"(?:^|[;&?,\s])([A-Za-z_][\w .-]{0,40}?)[ ]?=[ ]?([^;&,\s\"']+)")
_SCHEME = re.compile(r"(?i:bearer|basic|token) +(?=\S+$)")
#: Unquoted words of prose.
_PLAIN = re.compile(r"[^\W\d_]?[^\W\d_A-Z]{0,23}[.!?]?")
_HEAD = re.compile(r"[ \t]*(?:async[ \t]+)?def[ \t]")
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")

#: How strongly a word in a name says that its value is secret.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "passcode": 0.9, "pass": 0.7, "secret": 1.0, "secrets": 1.0, "token": 0.9, "apikey": 1.0,
    "credential": 0.9, "credentials": 0.9, "creds": 0.9, "bearer": 0.8, "authorization": 0.8, "auth": 0.5, "signature": 0.4, "dsn": 0.6, "jwt": 0.8, "otp": 0.6, "salt": 0.5, "privatekey": 1.0, "cookie": 0.4, "session": 0.3,
}
#: Words that make a following "key" secret.
_KEYED = {"api", "private", "access", "secret", "signing", "encryption", "master", "service", "client", "auth", "account", "storage", "deploy", "ssh"}
_BENIGN = {"type", "name", "file", "path", "url", "field", "label", "length", "policy", "hint", "expiry", "expires", "ttl", "count", "endpoint", "prefix", "header", "id"}
_PLACEHOLDER = re.compile(r"(?i)^(?:x+|\*+|\.+|-+|<.*>|\$\{.*|\{\{.*|%\w+%?|your.*|change.?me.*|example.*|dummy.*|test|todo|none|null|nil|true|false|undefined|password|secret|token|redacted|placeholder.*|process\.env.*|os\.environ.*|env\..*|getenv.*|\$\(.*|[\d.,:/ -]{1,12}|\d{4}-\d\d-\d\d.{0,16}|[a-z][a-z0-9+.-]*://[^\s@]*)$")
THRESHOLD = 0.6


@lru_cache(100_000)
def name_weight(name: str) -> float:
    """Sensitivity of an identifier, 0 to 1."""
    words = [w.lower() for w in _WORDS.findall(name)]
    best = max((SENSITIVE.get(w, 0.0) for w in words), default=0.0)
    for a, b in zip(words, words[1:]):
        if b in ("key", "keys") and a in _KEYED:
            best = max(best, 1.0)
        if a + b in SENSITIVE:
            best = max(best, SENSITIVE[a + b])
    if words and words[-1] in _BENIGN:
        best *= 0.3
    return best


class Value:
    """What a name holds: literals and other values, in order. Only sums over their characters are kept, so a constant's literals are neither copied nor counted again where it is used, however many there are."""

    __slots__ = ("literals", "parts", "n", "chars", "words", "head", "opens", "ends", "total")

    def __init__(self):
        self.literals: list[tuple[int, int]] = []
        self.parts: list[Value] = []
        self.n, self.chars, self.words, self.head, self.opens, self.ends, self.total = 0, Counter(), 0, "", True, True, 0.0

    def _append(self, n: int, chars: Counter, words: int, head: str, opens: bool, ends: bool) -> None:
        if not n:
            return
        self.words += words - (self.n > 0 and not self.ends and not opens)
        self.opens, self.ends = opens if not self.n else self.opens, ends
        self.n += n
        self.chars.update(chars)
        self.head = (self.head + head)[:4096] if len(self.head) < 4096 else self.head

    def add(self, a: int, b: int, text: str) -> "Value":
        if len(text) >= 6:
            self.literals.append((a, b))
        self._append(len(text), Counter(text), len(text.split()), text[:4096], text[:1].isspace(), text[-1:].isspace())
        return self

    def join(self, other: "Value") -> None:
        self.parts.append(other)
        self._append(other.n, other.chars, other.words, other.head, other.opens, other.ends)

    def weight(self) -> float:
        """How much the joined literals look like key material, 0 to 1."""
        n = self.n
        if n < 6 or len(self.chars) < 4 or _PLACEHOLDER.match(self.head):
            return 0.0
        entropy = -sum(c / n * math.log2(c / n) for c in self.chars.values() if c / n)
        seen = "".join(self.chars)
        kinds = sum(bool(re.search(p, seen)) for p in ("[a-z]", "[A-Z]", "[0-9]", r"[^A-Za-z0-9\s]"))
        if re.search(r"\s", seen) and n / (1 + self.words) < 12:
            return 0.1  # prose
        return min(1.0, 0.15 * kinds + min(entropy, 4.5) / 4.5 * 0.6 + min(n, 32) / 32 * 0.2)


def literal_weight(value: str) -> float:
    """How much a literal looks like key material, 0 to 1."""
    return Value().add(0, len(value), value).weight()


class Lexer:
    """One pass over a text: assignments in order, with what each name holds in its scope."""

    def __init__(self, text: str):
        self.text, self.at = text, 0
        self.scopes: list[tuple[int | None, dict[str, Value]]] = [(None, {})]  # indentation of a function head, None for braces
        self.values: list[tuple[float, Value]] = []
        self.last: tuple[str, str, int] | None = None  # name, literal and end of the last pair

    def find(self, name: str) -> Value | None:
        for _, held in reversed(self.scopes):
            if name in held:
                return held[name]
        return None

    def settle(self, path: str, value: Value, comment: bool = False, name: str = "") -> None:
        if not comment:
            self.scopes[-1][1][path] = value
        self.values.append((max(name_weight(path), name_weight(name)), value))

    def literal(self, m: re.Match, value: Value) -> None:
        """Adds a string token's literal; what it holds as a connection string are pairs of their own."""
        q = _QUOTED.match(m[0])
        a, b = m.start() + q.end(), m.end() - len(q[1])
        body = self.text[a:b]
        if scheme := _SCHEME.match(body):
            value.add(a + scheme.end(), b, body[scheme.end() :])
        else:
            value.add(a, b, body)
        if "=" in body and len(body) >= 12:
            for k in _WITHIN.finditer(body):
                if name_weight(k[1]) >= 0.3 and not _PLAIN.fullmatch(k[2]):
                    self.values.append((name_weight(k[1]), Value().add(a + k.start(2), a + k.end(2), k[2])))

    def quoted(self, m: re.Match) -> str:
        q = _QUOTED.match(m[0])
        return m[0][q.end() : len(m[0]) - len(q[1])]

    def block(self, m: re.Match) -> Value:
        """The lines behind a YAML block sign that are indented further than the line that it stands in."""
        start = self.text.rfind("\n", 0, m.start()) + 1
        own = re.compile(r"[ \t]*").match(self.text, start).end() - start
        return self.lines(m.end(), lambda line: line.strip() and len(line) - len(line.lstrip(" \t")) <= own)

    def lines(self, at: int, ends) -> Value:
        value = Value()
        while at < len(self.text):
            to = self.text.find("\n", at)
            to = len(self.text) if to < 0 else to
            line = self.text[at:to]
            if ends(line):
                break
            body = line.strip()
            if body:
                a = at + line.index(body)
                value.add(a, a + len(body), body)
            at = to + 1
        self.at = min(at, len(self.text))
        return value

    def value(self, op: str) -> tuple[Value, bool]:
        """What stands on the right of an assignment, and whether it is more than a name; ``self.at`` is behind it."""
        value, text, deep, empty = Value(), self.text, 0, True
        while True:
            m = _TOKEN.match(text, self.at)
            if not m:
                return value, not empty
            kind = m.lastgroup if m.lastgroup not in ("element", "content") else "tag"
            if kind == "space" or kind == "line" and deep and empty is not None and (empty or deep):
                self.at = m.end()
                continue
            if kind == "string":
                self.literal(m, value)
                self.at, empty = m.end(), False
            elif kind == "op" and m[0] == "(" and empty:
                self.at, deep = m.end(), deep + 1
                continue
            elif empty and op in (":", "=") and (b := _BLOCK.match(text, self.at)):
                return self.block(b), True
            elif empty and (b := _MARKER.match(text, self.at)):
                return self.lines(b.end(), lambda line, end=b[1]: line.strip() == end), True
            elif (raw := _RAW.match(text, self.at)) and kind not in ("comment", "flag"):
                path = _PATH.match(text, self.at)
                name = path[0] if path else None
                held = self.find(name) if name else None
                after = text[path.end() : path.end() + 1] if path else ""
                if held is not None and (path.end() == raw.end() or after in "+.|&"):
                    value.join(held)
                    self.at = path.end()
                elif path and after == "(":  # a call: its arguments are read as assignments of their own
                    self.at = path.end()
                    return value, True
                elif not empty:
                    return value, True
                else:
                    pieces = raw[0].split("+")
                    parts = [self.find(p) for p in pieces]
                    if len(pieces) > 1 and all(p is not None for p in parts):
                        for p in parts:
                            value.join(p)
                    elif not _PLAIN.fullmatch(raw[0]):
                        value.add(raw.start(), raw.end(), raw[0])
                    self.at = raw.end()
                empty = False
            else:
                return value, not empty
            # what joins on: an operator, or a string that just follows
            while (m := _TOKEN.match(text, self.at)) and (m.lastgroup == "space" or deep and m.lastgroup == "line"):
                self.at = m.end()
            if not m:
                return value, True
            if m.lastgroup == "op" and m[0] in ("+", ".", "..", "||", "&"):
                self.at = m.end()
                while (m := _TOKEN.match(text, self.at)) and m.lastgroup in ("space", "line"):
                    self.at = m.end()
            elif m.lastgroup == "op" and m[0] == ")" and deep:
                self.at, deep = m.end(), deep - 1
                return value, True
            elif m.lastgroup != "string":
                return value, True

    def run(self) -> list[tuple[float, Value]]:
        text, n = self.text, len(self.text)
        target: list[str] = []  # a path of names so far
        joint = False  # whether a sign that continues it came last
        call: list[str] = []
        comment = 0  # 1: to the line's end, 2: to its own end
        line = 0
        if _HEAD.match(text):
            self.scopes.append((len(text) - len(text.lstrip(" \t")), {}))
        while self.at < n:
            m = _TOKEN.match(text, self.at)
            kind = m.lastgroup if m.lastgroup not in ("element", "content") else "tag"
            start, self.at = self.at, m.end()
            if kind == "space":
                if target and not joint and text[self.at : self.at + 1] not in ":=+-<[":
                    target = []
                continue
            if kind == "line":
                target, joint, line = [], False, self.at
                comment = 0 if comment == 1 else comment
                if len(self.scopes) > 1 and self.scopes[-1][0] is not None:
                    rest = text[line : line + 400]
                    bare = rest.lstrip(" \t")
                    if bare and bare[0] != "\n":
                        while len(self.scopes) > 1 and self.scopes[-1][0] is not None and len(rest) - len(bare) <= self.scopes[-1][0]:
                            self.scopes.pop()
                if (head := _HEAD.match(text, line)) and not comment:
                    self.scopes.append((len(head[0]) - len(head[0].lstrip(" \t")), {}))
                continue
            if kind == "comment":
                target = []
                comment = {"/*": 2, "<!--": 2, "*/": 0, "-->": 0}.get(m[0], comment or 1)
                if m[0] == "//" and text[start - 1 : start] == ":":
                    comment = 0  # an address
                continue
            if kind == "tag":
                value = Value().add(m.start("content"), m.end("content"), m["content"])
                self.settle(m["element"], value, bool(comment))
                continue
            if kind == "flag":
                name = m[0].lstrip("-")
                self.at += text[self.at : self.at + 1] in ("=", " ", "\t")
                while text[self.at : self.at + 1] in (" ", "\t"):
                    self.at += 1
                if name_weight(name) >= 0.3 and text[self.at : self.at + 1] not in ("-", "", "\n"):
                    value = Value()
                    s = _TOKEN.match(text, self.at)
                    if s.lastgroup == "string":
                        self.literal(s, value)
                        self.at = s.end()
                    elif raw := _RAW.match(text, self.at):
                        if not _PLAIN.fullmatch(raw[0]):
                            value.add(raw.start(), raw.end(), raw[0])
                        self.at = raw.end()
                    self.settle(name, value, True)
                continue
            if kind == "name":
                if not joint:
                    target = []
                target.append(m[0])
                joint = False
                continue
            if kind == "string":
                body = self.quoted(m) if len(m[0]) < 200 else ""
                if joint and target and target[-1] == "[":
                    target.append(body)
                    joint = False
                else:
                    target = [] if not body.strip() or "\n" in body else [body]
                    if call and text[self.at : self.at + 20].lstrip(" \t").startswith(",") and _SETTER.fullmatch(call[-1]) and call[-1] != "":
                        comma = text.index(",", self.at)
                        follows = _TOKEN.match(text, comma + 1)
                        while follows and follows.lastgroup in ("space", "line"):
                            follows = _TOKEN.match(text, follows.end())
                        if follows and follows.lastgroup == "string":
                            self.at = follows.end()
                            value = Value()
                            self.literal(follows, value)
                            self.settle(body, value, bool(comment))
                            target = []
                    self._plain(m)
                continue
            if kind == "op":
                op = m[0]
                if op in (".", "->", "::", "[") and target:
                    target.append("[" if op == "[" else ".")
                    joint = True
                    continue
                if op == "]" and len(target) > 1 and target[-2] == "[":
                    target.append("]")
                    continue
                if op in ("=", ":=", "=>", ":", "+=") and target and not joint:
                    if op == ":" and text[self.at : self.at + 2] == "//":
                        target = []
                        continue
                    path = "".join(target)
                    if op == ":" and (t := _TYPE.match(text, self.at)):
                        self.at = t.end() + 1
                    before = self.at
                    value, any_ = self.value(op)
                    if not any_:
                        self.at = max(before, self.at)
                    if op == "+=" and (held := self.find(path)) is not None:
                        own, value = value, Value()
                        value.join(held)
                        value.join(own)
                    name = target[-2] if target[-1] == "]" else path
                    self.settle(path, value, bool(comment), name)
                    if name.lower() == "value" and self.last and self.last[0] in ("key", "name") and not text[self.last[2] : start].replace(name, "", 1).strip():
                        self.values.append((name_weight(self.last[1]), value))
                    self.last = (name.lower(), text[value.literals[0][0] : value.literals[0][1]] if value.literals else text[before : self.at].strip(" \t\"'"), self.at)
                    target = []
                    continue
                if op == "(":
                    call.append(target[-1] if target else "")
                elif op == ")" and call:
                    call.pop()
                elif op == "{":
                    self.scopes.append((None, {}))
                elif op == "}":
                    while len(self.scopes) > 1:
                        if self.scopes.pop()[0] is None:
                            break
            target, joint = [], False
        return self.values

    def _plain(self, m: re.Match) -> None:
        """Pairs of a connection string that nothing is assigned."""
        if "=" in m[0] and len(m[0]) >= 14:
            self.literal(m, Value())


def lex(text: str) -> list[tuple[int, int]]:
    """Spans of literals that sensitive names receive, directly or through constants, in order."""
    if not _STEMS.search(text.lower()):
        return []
    score: dict[tuple[int, int], float] = {}
    values = Lexer(text).run()
    for weight, value in values:
        if weight >= 0.3 and (own := value.weight()) > 0:
            value.total = max(value.total, weight * (0.35 + 0.65 * own))
    for _, value in reversed(values):  # a value's parts were there before it
        for part in value.parts:
            part.total = max(part.total, value.total)
        for k in value.literals:
            score[k] = max(score.get(k, 0.0), value.total)
    return sorted(k for k, v in score.items() if v >= THRESHOLD)


def base(text: str) -> list[tuple[int, int, str]]:
    spans = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        spans += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[1]) >= 12]
    if "AKIA" in text:
        spans += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    spans += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))


def scan(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans, and all spans, each by start and then kind as listed."""
    own = base(text)
    starts, ends = [s for s, _, _ in own], list(accumulate((e for _, e, _ in own), max))
    # of the base spans that start before a literal's end, one reaches into it if the farthest one does
    more = [(a, b, "lexed") for a, b in lex(text) if not (k := bisect_left(starts, b)) or ends[k - 1] <= a]
    return own, sorted(own + more, key=lambda s: (s[0], KINDS.index(s[2]))) if more else own


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def find_secrets(docs: DataFrame) -> DataFrame:
    """One row per document: counts of base kinds, digest of base spans, and all spans."""

    def kernel(part):
        rows = [scan(t) for t in part.column("text").to_pylist()]
        return {
            "doc_id": part.column("doc_id"),
            **{f"n_{k}": [sum(s[2] == k for s in own) for own, _ in rows] for k in KINDS[:3]},
            "base_sha256": [hashlib.sha256(joined(own).encode()).hexdigest() for own, _ in rows],
            "spans": [joined(all_) for _, all_ in rows],
            "n_lexed": [len(all_) - len(own) for own, all_ in rows],
        }

    return by_slice(slim(docs), kernel, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_lexed long")


def redact(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """The documents with every span's text replaced by ``mask``; ``n_chars``, where present, follows. Null texts stay null."""
    from pyspark.sql import functions as F
    from pyspark.sql.pandas.functions import pandas_udf

    @pandas_udf("string")
    def clean(texts):
        def one(t):
            if t is None:
                return None
            out, at = [], 0
            for a, b, _ in scan(t)[1]:
                if b <= at:
                    continue
                out += [t[at : max(a, at)], mask]
                at = b
            return "".join([*out, t[at:]])

        return texts.map(one, na_action="ignore")

    out = docs.withColumn("text", clean("text"))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
