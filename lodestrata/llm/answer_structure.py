"""Structure of one structured-output answer, decided by a stack automaton.

An answer is a payload (JSON, XML, YAML, TOML or CSV), possibly wrapped in code
markers or a fence and surrounded by prose.  ``read_answer`` splits the wrapping,
runs the automaton of the payload's notation over the *whole* text and says
whether the payload closed, which records it holds, and which text is prose.

Everything here is plain Python on one value; the Spark side calls it once per
row from Arrow batches (``answers.py``), so no state is kept between rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

# Wrapping markers of the answer protocol.
BEGIN_MARK, END_MARK = "<|BEGIN_CODE|>", "<|END_CODE|>"
NOTATIONS = ("JSON", "XML", "YAML", "TOML", "CSV")

#: White space, zero-width and other characters that show nothing.
INVISIBLE = "\u00a0\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180e\u2000-\u200f\u2028-\u202f\u205f-\u206f\u3000\u3164\ufe00-\ufe0f\ufeff\uffa0"
_BLANK = re.compile(rf"[\s{INVISIBLE}\x00-\x1f\x7f]+")
_MARKS = re.compile(r"<\|[A-Z_]{3,20}\|>|(?m:^[ \t>]*(?:`{3,}|~{3,})[ \t]*[\w+-]*[ \t]*$)|`{3,}\w*|~{3,}\w*")
_FENCE = re.compile(r"(?m)^[ \t]*(`{3,}|~{3,})[ \t]*([\w+-]*)[ \t]*$")
_CUT_SIGN = re.compile(r"(?:…|\.\.\.|\[(?:truncated|cut|\.\.\.|…)\]|�+)\s*$", re.I)
_BROKEN_TAIL = re.compile(r"(?:�+|[\ud800-\udfff]|\\u[0-9a-fA-F]{0,3}|(?<!\\)\\|&(?:#?\w{0,6}))\s*$")

_JSON_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|[{}\[\]]|"', re.S)
_XML_TOKEN = re.compile(r"<!--.*?-->|<!\[CDATA\[.*?\]\]>|<[?!][^<>]*>|<(/?)([^\s<>/!?]+)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*?)(/?)>", re.S)
_TOML_HEAD = re.compile(r"^\s*\[{1,2}[^\[\]]+\]{1,2}\s*$")
_TOML_PAIR = re.compile(r"^\s*(\"(?:[^\"\\]|\\.)*\"|'[^']*'|[\w.-]+)\s*=\s*(\S.*)$")
_YAML_PAIR = re.compile(r"^(\s*)(- +)?(\"(?:[^\"\\]|\\.)*\"|'[^']*'|[^\s:#\"'][^:#]*?):(?: +(\S.*))?\s*$")
_YAML_FIRST = re.compile(r"^\s*- +(\"[^\"]*\"|'[^']*'|[^\s:#][^:#,.]*):( |$)|^\s*(\"[^\"]*\"|[\w.-]+):( +\S+.*)?\s*$")
_VALUE_DONE = re.compile(r"\d{4}-\d\d-\d\d|true|false|null", re.I)


def visible(text: str | None) -> str:
    """The text without markers, fences, white space and invisible characters."""
    return _BLANK.sub("", _MARKS.sub("", text or ""))


_FIRST_SHOWN = re.compile(_MARKS.pattern + rf"|([^\s{INVISIBLE}\x00-\x1f\x7f])")


def shows(text: str | None) -> bool:
    """True where ``visible`` would leave something; looks no further than the first such character."""
    return any(m.group(1) for m in _FIRST_SHOWN.finditer(text or ""))


@dataclass
class Answer:
    """What the automaton found.

    complete: True (the payload closed), False (it did not), or None where the
    text holds no payload at all; reason names the first piece of evidence.
    """

    notation: str | None = None
    complete: bool | None = None
    reason: str = ""
    opened: str = ""  # 'marker', 'fence' or '' for a bare payload
    terminated: bool = False
    records: int = 0
    last_open: bool = False  # the last value could go on
    payload: str = ""
    prose: list[str] = field(default_factory=list)
    keys: list[str] = field(default_factory=list)
    values: list[str] = field(default_factory=list)


def _unwrap(text: str) -> tuple[str, str, str, str, bool]:
    """(before, body, after, opened, terminated) of the outermost wrapping."""
    at = text.find(BEGIN_MARK)
    if at >= 0:
        before, body = text[:at], text[at + len(BEGIN_MARK) :]
        end = body.rfind(END_MARK)
        if end >= 0:
            return before, body[:end], body[end + len(END_MARK) :], "marker", True
        return before, body, "", "marker", False
    end = text.rfind(END_MARK)
    if end >= 0:
        text, after = text[:end], text[end + len(END_MARK) :]
        return "", text, after, "", True
    fence = _FENCE.search(text)
    if fence:
        before, body = text[: fence.start()], text[fence.end() :]
        close = None
        for close in re.finditer(rf"(?m)^[ \t]*{re.escape(fence.group(1)[:3])}+[ \t]*$", body):
            break
        if close:
            return before, body[: close.start()], body[close.end() :], "fence", True
        return before, body, "", "fence", False
    return "", text, "", "", False


def _json(body: str, out: Answer) -> bool:
    start = min((i for i in (body.find("{"), body.find("[")) if i >= 0), default=-1)
    if start < 0:
        return False
    stack: list[str] = []
    end = -1
    for m in _JSON_TOKEN.finditer(body, start):
        tok = m.group()
        head = tok[0]
        if head == '"':
            if len(tok) == 1:
                out.complete, out.reason = False, "unclosed_quote"
                tail = body[m.end() :]
                out.values.append(tail)
                out.payload, end = body[start:], len(body)
                break
            after = body[m.end() : m.end() + 2].lstrip()
            if after[:1] == ":":
                out.keys.append(tok[1:-1])
            else:
                out.values.append(tok[1:-1])
        elif head in "{[":
            if head == "{" and stack[-1:] == ["["]:
                out.records += 1
            stack.append(head)
        else:
            if not stack or (stack.pop() == "{") != (head == "}"):
                out.complete, out.reason = True, "mismatched_bracket"
            if not stack:
                end = m.end()
                out.complete = True
                break
    if end < 0:
        out.complete, out.reason, end = False, "unclosed_bracket", len(body)
    out.records = out.records or 1
    out.payload = body[start:end]
    rest = body[end:]
    if out.complete and rest.strip():
        out.prose.append(rest)
    if body[:start].strip():
        out.prose.append(body[:start])
    return True


def _xml(body: str, out: Answer) -> bool:
    first = None
    for m in _XML_TOKEN.finditer(body):
        if m.group(2) and not m.group(1):
            first = m
            break
    if first is None:
        return False
    start, stack, end, last = first.start(), [], -1, first.start()
    for m in _XML_TOKEN.finditer(body, start):
        gap = body[last : m.start()].strip()
        last = m.end()
        if gap and "<" not in gap:
            out.values.append(gap)
        name = m.group(2)
        if not name:
            continue
        if m.group(1):
            while stack and stack[-1] != name:
                stack.pop()
                out.reason = "mismatched_markup"
            if stack:
                stack.pop()
            if not stack:
                end = m.end()
                break
        elif not m.group(4):
            stack.append(name)
            out.keys.append(name)
            if len(stack) == 2:
                out.records += 1
    if end >= 0:
        out.complete = True
    else:
        out.complete, out.reason, end = False, "unclosed_markup", len(body)
        out.values.append(body[last:].strip())
    out.payload = body[start:end]
    for part in (body[:start], body[end:]):
        if part.strip():
            out.prose.append(part)
    return True


def _quotes_closed(value: str, doubled: bool = False) -> bool:
    value = value.strip()
    if value[:1] == '"':
        if doubled:
            return value.count('"') % 2 == 0
        return bool(re.fullmatch(r'"(?:[^"\\]|\\.)*"\s*(?:#.*)?', value, re.S)) and len(value) > 1
    if value[:1] == "'":
        return len(value) > 1 and value.rstrip().endswith("'")
    return True


_UPPER, _LOWER, _DIGIT = re.compile(r"[^\W\d_a-z]"), re.compile(r"[a-z]"), re.compile(r"\d")


def _form(value: str) -> str:
    """The form of a code: letters as A or a, digits as 9; empty for a value that is not made of both."""
    if not _DIGIT.search(value) or not (_UPPER.search(value) or _LOWER.search(value)) or " " in value:
        return ""
    return _DIGIT.sub("9", _LOWER.sub("a", _UPPER.sub("A", value)))


def _code_form(earlier: list[str]) -> str:
    """The one form that all earlier values of a field share, or nothing."""
    forms = {_form(e) for e in earlier}
    return forms.pop() if len(forms) == 1 else ""


def _open_end(value: str, earlier: list[str]) -> bool:
    """True where an unquoted last value could be the beginning of a longer one: it is no date or constant, and no code of the form that the field's earlier values share."""
    v = value.strip()
    if v[-1:] in "\"'" and len(v) > 1 or _VALUE_DONE.fullmatch(v):
        return False
    form = _code_form(earlier)
    return not form or _form(v) != form


_BEGUN_WORD = re.compile(r"t|tr|tru|f|fa|fal|fals|nu|nul|\d{4}-\d?\d?-?\d?")
_SHAPES = tuple(map(re.compile, (r"true|false", r"\d{4}-\d\d-\d\d", r"-?\d+\.\d+")))


def _unlike(value: str, earlier: list[str]) -> bool:
    """True where an unquoted last value is the beginning of a value: by itself, or held against the same field's earlier values."""
    v = value.strip()
    if not v or v[0] in "\"'":
        return False
    if _BEGUN_WORD.fullmatch(v):
        return True
    if not earlier:
        return False
    for shape in _SHAPES:
        if not shape.fullmatch(v) and all(shape.fullmatch(e) for e in earlier):
            return True
    form = _code_form(earlier)
    if form and len(v) < len(form) and form.startswith(_form(v) or _UPPER.sub("A", _LOWER.sub("a", v))):
        return True
    if v.isalpha() and v.islower() and len(v) < 4 and all(e.isalpha() and e.islower() and len(e) >= 4 or " " in e for e in earlier):
        return True
    return any(e != v and e.startswith(v) and not v[0].isdigit() for e in earlier)


def _keyed(lines: list[str], out: Answer, yaml: bool) -> bool:
    """YAML and TOML lists of records: every record has the keys of the fullest one before it."""
    first = next((i for i, x in enumerate(lines) if (_YAML_FIRST if yaml else _TOML_HEAD).match(x)), None)
    if not yaml and first is None:
        first = next((i for i, x in enumerate(lines) if _TOML_PAIR.match(x)), None)
    if first is None:
        return False
    if yaml and sum(bool(_YAML_PAIR.match(x)) for x in lines[first:]) < 2 and not (len(lines) - first <= 2 and lines[first].rstrip().endswith(":") and " " not in lines[first].strip()):
        return False
    records: list[list[str]] = []
    state, tail, last_value = "ok", "", ""
    used = first
    for i in range(first, len(lines)):
        line = lines[i]
        if not line.strip():
            continue
        if not yaml and _TOML_HEAD.match(line):
            records.append([])
            state, used, last_value = "ok", i + 1, "]"
            continue
        m = (_YAML_PAIR if yaml else _TOML_PAIR).match(line)
        if m and yaml:
            indent, dash, key, value = m.group(1), m.group(2), m.group(3), m.group(4) or ""
            if not indent and not dash and records and value and " " in key:
                state, tail = "prose", line
                break
            if not indent and not dash and not value:
                state, used, last_value = "ok", i + 1, ":"
                continue
            if dash or not records:
                records.append([])
        elif m:
            key, value = m.group(1), m.group(2)
            if not records:
                records.append([])
        if not m:
            state, tail = "tail", line
            break
        records[-1].append(key.strip("\"'"))
        out.keys.append(key.strip("\"'"))
        out.values.append(value.strip().strip("\"'"))
        used, last_value, state = i + 1, value, "ok"
        if not _quotes_closed(value):
            out.complete, out.reason = False, "unclosed_quote"
            out.payload = "\n".join(lines[first : i + 1])
            out.records = len(records)
            return True
    out.records = len(records)
    rest = "\n".join(lines[used:]).strip()
    want = max((len(r) for r in records[:-1]), default=0)
    have = len(records[-1]) if records else 0
    full = have >= want and have > 0
    out.payload = "\n".join(lines[first:used])
    if state == "tail" and rest:
        expected = records[0][have] if records and have < len(records[0]) else ""
        begun = rest.split("\n")[0].strip()
        partial = begun[:1] in "\"'[-" or bool(expected and expected.startswith(begun)) or bool(re.fullmatch(r"[\w\"'.-]*(\s*=?\s*|:?)", begun)) and "\n" not in rest
        if partial and not (full and begun[:1] not in "\"'[-" and re.search(r"[.!?。]\s*$", rest)):
            out.complete, out.reason = False, "unfinished_line"
            out.payload += "\n" + rest
        else:
            out.prose.append(rest)
    elif state == "prose":
        out.prose.append(rest)
    if out.complete is None:
        if not records or not full:
            out.complete, out.reason = False, "unfinished_record"
        else:
            earlier = [v for k, v in zip(out.keys[:-1], out.values[:-1]) if k == out.keys[-1]]
            out.complete, out.last_open = True, not out.prose and _open_end(last_value, earlier)
            if last_value.strip() in ("", "]", ":"):
                out.complete, out.reason = False, "unfinished_record"
            elif out.last_open and not out.terminated:
                if _unlike(last_value, earlier):
                    out.complete, out.reason = False, "unfinished_value"
    before = "\n".join(lines[:first])
    if before.strip():
        out.prose.append(before)
    return True


def _fields(row: str) -> list[str]:
    """Fields of one CSV record, split at commas outside quotes."""
    if '"' not in row:
        return row.split(",")
    return [x for x in re.findall(r'((?:[^,"]|"(?:[^"]|"")*"?)*)(?:,|$)', row)][: _commas(row) + 1]


def _commas(row: str) -> int:
    return re.sub(r'"(?:[^"]|"")*"?', "", row).count(",")


def _csv(lines: list[str], out: Answer) -> bool:
    first = next((i for i, x in enumerate(lines) if x.count(",") >= 1 and not re.search(r"[.!?:。]\s*$", x) and not re.search(r",\s", x)), None)
    if first is None:
        return False
    head = _fields(lines[first])
    out.keys = [x.strip().strip('"') for x in head]
    want, i, last, used = len(head), first + 1, "", first + 1
    rows = 0
    while i < len(lines):
        row = lines[i]
        while row.count('"') % 2 and i + 1 < len(lines) and row.count('"') < 4 * want:
            nxt = lines[i + 1]
            if nxt.count('"') % 2 == 0 and re.match(r"\s*[\w-]+(,|$)", nxt):
                break
            i += 1
            row += "\n" + nxt
        if not row.strip():
            i += 1
            continue
        got = _commas(row) + 1
        if row.count('"') % 2:
            out.complete, out.reason = False, "unclosed_quote"
            out.values += [x.strip('"') for x in _fields(row)]
            rows, used = rows + 1, len(lines)
            break
        if got < want:
            rest = "\n".join(lines[i:]).strip()
            sentence = bool(re.search(r"[.!?。]\s*$", rest)) and (" " in rest.strip() or "。" in rest)
            if sentence and not (got > 1 and re.search(r"\w,\w", rest)):
                out.prose.append(rest)
                last = '"."'
            else:
                out.complete, out.reason = False, "unfinished_record"
                out.values += [x.strip('"') for x in _fields(row)]
                rows += 1
            break
        fields = _fields(row)
        out.values += [x.strip('"') for x in fields]
        last, used, rows = fields[-1] if fields else "", i + 1, rows + 1
        i += 1
    out.records = rows
    out.payload = "\n".join(lines[first:used])
    if out.complete is None:
        if not rows:
            out.complete, out.reason = False, "unfinished_record"
        else:
            earlier = out.values[want - 1 : -1 : want] if len(out.values) == rows * want else []
            out.complete, out.last_open = True, not out.prose and _open_end(last, earlier)
            if not last.strip():
                out.complete, out.reason = False, "unfinished_record"
            elif out.last_open and not out.terminated and _unlike(last, earlier):
                out.complete, out.reason = False, "unfinished_value"
    before = "\n".join(lines[:first])
    if before.strip():
        out.prose.append(before)
    return True


def read_answer(text: str | None, notation: str | None) -> Answer:
    """Run the automaton of ``notation`` (upper case; other names mean: guess) over a text.

    Null, empty and invisible texts give an Answer without payload.
    """
    out = Answer()
    if not shows(text):
        return out
    text = text.replace("\r\n", "\n")
    sign = _CUT_SIGN.search(text)
    if sign:
        text = text[: sign.start()]
    before, body, after, out.opened, out.terminated = _unwrap(text)
    wanted = (notation or "").strip().upper()
    tries = [wanted] if wanted in NOTATIONS else []
    stripped = body.lstrip(" \n\t\ufeff")
    if stripped[:1] in "{[" and not stripped.startswith("[["):
        tries.insert(0, "JSON")
    elif stripped.startswith("[[") and _TOML_HEAD.match(stripped.split("\n", 1)[0]):
        tries.insert(0, "TOML")
    elif stripped[:1] == "<":
        tries.insert(0, "XML")
    for name in dict.fromkeys(tries):
        part = Answer(opened=out.opened, terminated=out.terminated)
        lines = body.split("\n")
        found = _json(body, part) if name == "JSON" else _xml(body, part) if name == "XML" else _csv(lines, part) if name == "CSV" else _keyed(lines, part, name == "YAML")
        if found:
            part.notation = name
            out = part
            break
    else:
        out.prose.append(body)
    for extra in (before, after):
        if extra.strip():
            out.prose.append(extra)
    closed = out.terminated or out.notation in ("JSON", "XML")
    if sign and out.complete and not closed:
        out.complete, out.reason = False, "cut_sign"
    elif out.complete is False and _BROKEN_TAIL.search(text):
        out.reason = "broken_character"
    if out.complete is False and not out.reason:
        out.reason = "unfinished_record"
    return out


_COUNT = re.compile(r"(?<![\w.,-])(\d{1,9})(?![\w-]|[.,]\d)|(\d{1,9})(?=[件個つ行項])")
_FIELD_LIST = re.compile(r"(?:\w+, )+\w+")


def requested(query: str | None, source: str | None) -> tuple[int, set[str]]:
    """(least records, field names) a query asks for; (0, empty) where it doesn't say.

    The count is the first number of the instruction line that stands alone; where the query
    carries its own data, it is the number of records in that data.
    """
    line, _, rest = (query or "").partition("\n")
    lists = [x.lower().split(", ") for x in _FIELD_LIST.findall(line)]
    fields = set(max(lists, key=len)) if lists else set()
    wanted = (source or "").strip().upper()
    if wanted in NOTATIONS and rest.strip():
        return read_answer(rest, wanted).records, fields
    m = _COUNT.search(line)
    return (int(m.group(1) or m.group(2)) if m else 0), fields
