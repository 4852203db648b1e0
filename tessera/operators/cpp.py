"""Scopes of C++ files (TGF13, TGF23, GRF03): a pushdown scanner over tokens.

Comments, strings, raw strings and preprocessor lines are tokens, so nothing in them counts as code. A stack holds what is open:
namespaces, classes, function bodies, other braces. The tokens since the last end of a statement say what a brace opens and what
a semicolon declares. One pass over a file; files are rows, and no file needs another.

Of a conditional's branches the first counts (of `#if 0`, the next), so that braces stay paired. A closing brace too many is
ignored; what is open at the end of a file stays as found. A null text has no rows.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera import storage

#: Rows in a batch that a task gives back, about.
BATCH = 10_000
TOKEN = re.compile(
    r"""(?P<comment>//(?:\\\n|[^\n])*|/\*.*?(?:\*/|\Z))
    |(?P<line>^[ \t]*\#(?:\\\n|/\*.*?\*/|(?!//)[^\n])*)
    |(?P<string>(?:u8|[uUL])?R"(?P<mark>[^()\s\\"]{0,16})\(.*?(?:\)(?P=mark)"|\Z)|(?:u8|[uUL])?"(?:\\.|[^"\\\n])*"?)
    |(?P<number>\d(?:'(?=\w)|[\w.]|(?<=[eEpP])[+-])*)
    |(?P<char>(?:u8|[uUL])?'(?:\\.|[^'\\\n])*'?)
    |(?P<name>[A-Za-z_]\w*)
    |(?P<mark_>::|->|\[\[|\]\]|[^\s])""",
    re.S | re.X | re.M,
)
CLASS, ACCESS = {"class", "struct", "union"}, {"public", "protected", "private"}
#: Words before a parenthesis that don't name a function.
NOT_CALLED = {"if", "for", "while", "switch", "return", "catch", "sizeof", "alignof", "alignas", "decltype", "noexcept", "typeid", "static_assert", "defined", "throw", "new", "delete", "operator", "requires", "explicit", "__attribute__", "__declspec", "co_return", "co_await", "co_yield", "case", "constexpr", "else", "do", "and", "or", "not"}
#: Words behind which a name with a parenthesis is still a call, not a declaration.
BEFORE_CALL = {"return", "else", "do", "case", "throw", "new", "delete", "co_return", "co_await", "co_yield", "and", "or", "not", "in"}
AFTER_ARGUMENTS = {"const", "volatile", "noexcept", "override", "final", "throw", "try", "requires", "=", "&", "->", ":", "[[", "{", "mutable"}
SCHEMA = "kind string, parent string, name string, detail string, type string, access string, line int"
WORD = re.compile(r"[A-Za-z_]\w*$")
#: A macro that stands in a class without a semicolon, before a type and a name.
MACRO = re.compile(r"[A-Z][A-Z0-9]*_[A-Z0-9_]*$")


def tokens(code: str):
    """(text, line) of the code's tokens, and ("#include", name) for include lines; text in strings is left out."""
    line, at, skipped, taken = 1, 0, 0, []
    for m in TOKEN.finditer(code):
        line += code.count("\n", at, m.start())
        at, kind, text = m.start(), m.lastgroup, m.group()
        if kind == "line":
            word, _, rest = re.sub(r"\\\n|/\*.*?\*/", " ", text).strip()[1:].strip().partition(" ")
            word, rest = (re.match(r"\w*", word).group(), word[len(re.match(r"\w*", word).group()) :] + " " + rest)
            if word in ("if", "ifdef", "ifndef"):
                off = word == "if" and rest.strip() == "0"
                taken.append(not off)
                skipped += skipped > 0 or off
            elif word in ("elif", "else", "elifdef", "elifndef") and taken:
                if skipped <= 1:
                    skipped, taken[-1] = int(taken[-1]), True
            elif word == "endif" and taken:
                taken.pop()
                skipped = max(0, skipped - 1)
            elif word == "include" and not skipped and (found := re.search(r'"([^"]+)"|<([^>]+)>', rest)):
                yield "#include", line, found.group(1) or found.group(2), "" if found.group(1) else "system"
        elif kind != "comment" and not skipped:
            yield ('""' if kind == "string" else "''" if kind == "char" else text), line, "", ""


def depths(head: list[str]) -> list[int]:
    """How many parentheses, brackets and template arguments each token stands in; a template opens behind a name."""
    out, open_ = [], []
    for i, t in enumerate(head):
        closes = t in (")", "]", "]]", "}") or t == ">" and open_[-1:] == ["<"]
        if closes and t != ">":
            while open_ and open_[-1] == "<":
                open_.pop()
        if closes and open_:
            del open_[-2 if t == "]]" and open_[-1] != "[[" else -1 :]
        out.append(len(open_))
        if t in ("(", "[", "[[", "{") or t == "<" and i and WORD.match(head[i - 1]) and head[i - 1] != "operator":
            open_.append(t)
    return out


def text_of(part: list[str]) -> str:
    """Tokens as text: blanks between words, behind commas and behind `*`, `&`, `>` before a word."""
    out = ""
    for t in part:
        word = t[0].isalnum() or t[0] in "_\"'~"
        out += (" " if out and (word and (out[-1].isalnum() or out[-1] in "_,*&>=\"')") or out[-1] in ",=" or t == "=") else "") + t
    return out


def without_prefix(head: list[str]) -> list[str]:
    """A statement's tokens without template heads, attributes and access labels in front."""
    while head:
        if head[0] in ("template", "[[", "alignas", "__attribute__", "__declspec", "extern", "export", "inline", "static", "virtual", "explicit", "constexpr", "friend", "typedef") or head[0] == '""':
            d = depths(head)
            if head[0] in ("template", "[[", "alignas", "__attribute__", "__declspec") and len(head) > 1:
                first = 0 if head[0] == "[[" else 1
                end = next((i for i in range(first + 1, len(head)) if d[i] <= d[first] and head[i] in (">", "]]", ")")), None)
                if end is None:
                    return head
                head = head[end + 1 :]
            elif head[0] in ("friend", "typedef"):
                return head
            else:
                head = head[1:]
        else:
            return head
    return head


def named_class(head: list[str], d: list[int]) -> tuple[str, str] | None:
    """(name, bases) if the statement heads a class."""
    at = next((i for i, t in enumerate(head) if t in CLASS and not d[i]), None)
    if at is None or "enum" in head[:at]:
        return None
    colon = next((i for i in range(at, len(head)) if head[i] == ":" and not d[i]), len(head))
    part, i = [], at + 1
    while i < colon:
        if head[i] in ("alignas", "__attribute__", "__declspec") and i + 1 < colon or head[i] == "[[":
            i = next((j for j in range(i + 1, colon) if head[j] in (")", "]]") and d[j] == d[i]), colon)
        elif not d[i] and head[i] in ("(", "="):
            return None
        elif not d[i] and WORD.match(head[i]) and head[i] != "final":
            part = [*part, "::", head[i]] if head[i - 1] == "::" and part else [head[i]]
        i += 1
    return "".join(part), text_of(head[colon + 1 :])


def declarator(head: list[str], d: list[int]) -> tuple[int, int, str, str] | None:
    """(first token of the name, opening parenthesis, qualifier, name) of the function that a statement declares."""
    for i, t in enumerate(head):
        if d[i]:
            continue
        if t == "operator":
            stop = i + 3 if head[i + 1 : i + 3] == ["(", ")"] else next((j for j in range(i + 1, len(head)) if head[j] == "("), None)
            if stop is None or stop < i + 2 or stop >= len(head) or head[stop] != "(":
                return None
            between = head[i + 1 : stop]
            return *qualified(head, i), "operator" + (f" {text_of(between)}" if WORD.match(between[0]) else "".join(between)), stop
        if t == "=":
            return None
        if t == "(" and i and WORD.match(head[i - 1]) and head[i - 1] not in NOT_CALLED and head[i + 1 : i + 2] != ["*"]:
            first = i - 2 if i > 1 and head[i - 2] == "~" else i - 1
            return *qualified(head, first), "".join(head[first:i]), i
    return None


def qualified(head: list[str], first: int) -> tuple[int, str]:
    """Where a qualified name that ends before first begins, and its qualifier without template arguments."""
    names, i = [], first
    while i >= 2 and head[i - 1] == "::":
        j = i - 2
        if head[j] == ">":
            deep = 0
            while j >= 0:
                deep += (head[j] == ">") - (head[j] == "<")
                if not deep:
                    break
                j -= 1
            j -= 1
        if j < 0 or not WORD.match(head[j]):
            break
        names.insert(0, head[j])
        i = j
    return i - 1 if i >= 1 and head[i - 1] == "::" else i, "::".join(names)


def function(head: list[str]) -> tuple[str, str, str, str, list[str]] | None:
    """(qualifier, name, arguments, type, what follows the arguments); a macro call in front of a declaration is passed over."""
    for _ in range(4):
        d = depths(head)
        found = declarator(head, d)
        if not found:
            return None
        begin, qualifier, name, at = found
        end = next((i for i in range(at + 1, len(head)) if head[i] == ")" and d[i] == d[at]), None)
        if end is None:
            return None
        after = head[end + 1 :]
        if after and after[0] not in AFTER_ARGUMENTS and not begin:
            head = without_prefix(after)
            continue
        return qualifier, name, text_of(head[at + 1 : end]), text_of(without_prefix(head[:begin])), after
    return None


def fields(head: list[str]):
    """(name, type) of the variables that a statement declares."""
    head = without_prefix(head)
    if MACRO.match(head[0]) and sum(bool(WORD.match(t)) for t in head[:4]) > 2:
        head = head[1:]
    d, parts, last = depths(head), [], 0
    for i, t in enumerate(head):
        if t == "," and not d[i]:
            parts.append(head[last:i])
            last = i + 1
    kind: list[str] = []
    for n, part in enumerate([*parts, head[last:]]):
        d = depths(part)
        pointer = next((i for i in range(len(part) - 1) if part[i] == "(" and part[i + 1] == "*" and not d[i]), None)
        if pointer is not None and not n:
            name = next((t for t in part[pointer:] if WORD.match(t)), "")
            yield name, text_of(part[:pointer])
            return
        stop = next((i for i, t in enumerate(part) if not d[i] and t in ("=", ":", "[", "{}") and i), len(part))
        names = [i for i in range(stop) if WORD.match(part[i]) and not d[i]]
        if names and (n or names[-1] > 0):
            at = names[-1]
            if not n:
                kind = part[:at]
                while kind and kind[-1] in ("*", "&"):
                    kind = kind[:-1]
            yield part[at], text_of(part[:at] if not n else kind + part[:at])


def constructs(code: str):
    """(kind, parent, name, detail, type, access, line) in the order of the file."""
    stack: list[list] = []  # [what, name, access]
    head: list[str] = []
    began = 1
    scope = lambda extra="": "::".join([*(s[1] for s in stack if s[1]), *([extra] if extra else [])])
    seen: list[str] = []  # a body's tokens since its last statement, for calls
    for t, line, name, more in tokens(code):
        if t == "#include":
            yield "include", "", name, more, "", "", line
            continue
        what = stack[-1][0] if stack else "file"
        if what in ("init", "skip"):
            if t == "{":
                stack.append([what, "", ""])
            elif t == "}":
                stack.pop()
                if what == "init" and (not stack or stack[-1][0] != "init"):
                    head.append("{}")
            continue
        if not head:
            began = line
        if what == "body":
            if t == "(":
                yield from called(seen, scope(), line)
            if t in ("{", "}", ";"):
                kind = named_class(without_prefix(seen), depths(without_prefix(seen))) if t == "{" and CLASS & set(seen) else None
                if kind:
                    yield "class", scope(), kind[0], kind[1], "", "", line
                    stack.append(["class", kind[0], "private" if "class" in seen else "public"])
                elif t == "{":
                    stack.append(["body", "", ""])
                elif t == "}":
                    stack.pop()
                seen = []
            else:
                seen.append(t)
            continue
        if t == "{":
            bare = without_prefix(head)
            d = depths(bare)
            if bare[:1] == ["namespace"]:
                name = text_of([x for x in bare[1:] if x != "inline"])
                if name:
                    yield "namespace", scope(), name, "", "", "", began
                stack.append(["namespace", name, ""])
            elif "enum" in bare and "(" not in bare:
                stack.append(["skip", "", ""])
            elif (kind := named_class(bare, d)) is not None:
                yield "class", scope(), kind[0], kind[1], "", stack[-1][2] if what == "class" else "", began
                stack.append(["class", kind[0], "private" if "class" in bare else "public"])
            elif found := function(bare):
                qualifier, name, arguments, type_, after = found
                starts = ":" in after and "->" not in after and bool(WORD.match(bare[-1]) or bare[-1] == ">")
                if starts:  # a member's first value in braces
                    stack.append(["init", "", ""])
                    continue
                kind = "method" if what == "class" else "function"
                yield kind, scope(qualifier), name, arguments, type_, stack[-1][2] if kind == "method" else "", began
                stack.append(["body", f"{qualifier}::{name}" if qualifier else name, ""])
                seen = []
            elif head in (["extern", '""'], []):
                stack.append(["open", "", ""])
            else:
                stack.append(["init", "", ""])
                continue
            head = []
        elif t == "}":
            if stack:
                closed = stack.pop()
                head = [closed[1]] if closed[0] == "class" and closed[1] else []
        elif t == ";":
            if what == "class" and len(head) > 1:
                yield from member(head, scope(), stack[-1][2], began)
            head = []
        elif t == ":" and what == "class" and head and (head[-1] in ACCESS or head[-1] in ("slots", "Q_SLOTS") and head[-2:-1] and head[-2] in ACCESS):
            stack[-1][2] = head[-1] if head[-1] in ACCESS else head[-2]
            head = []
        else:
            head.append(t)


def member(head: list[str], scope: str, access: str, line: int):
    bare = without_prefix(head)
    if not bare or bare[0] in ("using", "typedef", "friend", "static_assert") or bare[0] in CLASS | {"enum"} and len(bare) <= 2:
        return
    if found := function(bare):
        qualifier, name, arguments, type_, _ = found
        yield "method", scope, name, arguments, type_, access, line
    else:
        for name, type_ in fields(bare):
            yield "field", scope, name, type_, type_, access, line


def called(seen: list[str], scope: str, line: int):
    """The call whose opening parenthesis follows the tokens seen, if it is one."""
    end = len(seen)
    if seen[-1:] == [">"]:
        deep, i = 0, end - 1
        while i > 0 and end - i < 60 and (WORD.match(seen[i]) or seen[i] in ("<", ">", ",", "::", "*", "&") or seen[i][0].isdigit()):
            deep += (seen[i] == ">") - (seen[i] == "<")
            if not deep:
                break
            i -= 1
        if deep or not i:
            return
        end = i
    if not end or not WORD.match(seen[end - 1]) or seen[end - 1] in NOT_CALLED:
        return
    begin, qualifier = qualified(seen, end - 1)
    before = seen[begin - 1] if begin else ""
    if WORD.match(before or " ") and before not in BEFORE_CALL or before in ("*", "&") and begin > 1 and WORD.match(seen[begin - 2]) and begin == 2:
        return  # a declaration with arguments
    if before == ">" and begin > 2 and seen[0] != "return" and "=" not in seen[:begin] and "(" not in seen[:begin]:
        return
    subject = seen[begin - 2] if begin > 1 and before in (".", "->") and WORD.match(seen[begin - 2]) else ""
    name = f"{qualifier}::{seen[end - 1]}" if qualifier else seen[end - 1]
    yield "call", scope, name, subject, "new" if before == "new" else "", "", line


def cpp_constructs(files: DataFrame, path: str = "path", code: str = "code") -> DataFrame:
    """TGF13, TGF23, GRF03: path, kind, parent, name, detail, type, access, line of a C++ file's constructs.

    Kinds: include (detail: "system" for <...>), namespace, class (detail: bases), field (detail and type: its type), method and
    function (detail: arguments; type: what it returns), call (detail: the object it is called on; type: "new" for a
    construction). parent is the qualified name of what it stands in: namespaces, classes, and for calls the function.
    Files are spread over all tasks, since a scan costs far more than a shuffle of the text.
    """
    schema = pa.schema([("path", pa.string()), *((c, pa.string()) for c in ("kind", "parent", "name", "detail", "type", "access")), ("line", pa.int32())])

    def batch(found):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), schema.types, strict=True)], schema=schema)

    def scan(batches):
        found: list[tuple] = []
        for b in batches:
            for p, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found += [(p, *row) for row in constructs(text or "")]
                if len(found) >= BATCH:
                    yield batch(found)
                    found = []
        if found:
            yield batch(found)

    return storage.spread(files.select(F.col(path).cast("string").alias("path"), F.col(code).alias("code"))).mapInArrow(scan, f"path string, {SCHEMA}")
