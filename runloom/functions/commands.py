"""Shell commands to ordered edit and check events, and outputs of checks to outcomes.

A small reader walks a command once, character by character, and yields its simple commands with words, redirections
and here-documents; the rules then look at words only, so nothing inside quotes is taken for an operator.
"""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

# fixed values: programs that run tests, words that only wrap a command, endings that mark captured output
RUNNERS = ("pytest", "py.test", "tox", "nosetests")
MODULES = ("pytest", "unittest", "nose")
WRAPPERS = ("sudo", "time", "nice", "env", "xvfb-run", "command", "exec")
CAPTURE = (".txt", ".log", ".out", ".err", ".patch", ".diff")
EDITORS = ("apply_patch", "str_replace", "edit")
ROOT = "/testbed"


@dataclass
class Simple:
    """One simple command: words without quotes, outputs it is redirected to, here-documents, and the operator before it."""

    words: list[str] = field(default_factory=list)
    outputs: list[str] = field(default_factory=list)
    documents: list[str] = field(default_factory=list)
    after: str = ""


def read(command: str) -> list[Simple]:
    """The simple commands of a command line in order."""
    out, now, word, started = [], Simple(), [], False
    expects = ""  # what the next word is: an output target, a here-document's end, or a file to skip
    pending: list[tuple[Simple, str, bool]] = []
    i, n = 0, len(command)

    def finish_word() -> None:
        nonlocal word, started, expects
        if not started:
            return
        text = "".join(word)
        if expects == "out":
            now.outputs.append(text)
        elif expects.startswith("doc"):
            pending.append((now, text, expects == "doc-"))
        elif not expects:
            now.words.append(text)
        word, started, expects = [], False, ""

    def finish_simple(operator: str) -> None:
        nonlocal now
        finish_word()
        if now.words or now.outputs or now.documents or any(p[0] is now for p in pending):
            out.append(now)
        elif operator == "\n" and now.after:
            return  # a new line right after an operator goes on
        now = Simple(after=operator)

    while i < n:
        c = command[i]
        if c == "\\" and i + 1 < n:
            if command[i + 1] != "\n":
                word.append(command[i + 1])
                started = True
            i += 2
        elif c == "'":
            end = command.find("'", i + 1)
            end = n if end < 0 else end
            word.append(command[i + 1 : end])
            started, i = True, end + 1
        elif c == '"':
            i += 1
            started = True
            while i < n and command[i] != '"':
                if command[i] == "\\" and i + 1 < n and command[i + 1] in '"\\$`\n':
                    i += 1
                word.append(command[i])
                i += 1
            i += 1
        elif c == "\n":
            finish_word()
            owners = pending[:]
            pending.clear()
            finish_simple("\n")
            i += 1
            for owner, mark, dash in owners:
                body = []
                while i < n:
                    end = command.find("\n", i)
                    end = n if end < 0 else end
                    line, i = command[i:end], end + 1
                    if (line.strip() if dash else line.rstrip()) == mark:
                        break
                    body.append(line)
                owner.documents.append("\n".join(body))
        elif command.startswith("<<", i) and not command.startswith("<<<", i):
            finish_word()
            dash = command.startswith("<<-", i)
            expects = "doc-" if dash else "doc"
            i += 3 if dash else 2
        elif c in "<>":
            digit = started and "".join(word).isdigit() and command[i - 1].isdigit()
            amp = bool(i) and command[i - 1] == "&"
            if digit:
                word, started = [], False
            finish_word()
            width = 2 if command.startswith(c * 2, i) else 1
            i += width
            if command.startswith("&", i):
                expects, i = "skip", i + 1
            else:
                expects = "out" if c == ">" and not digit and not amp else "skip"
        elif command.startswith(("&&", "||"), i):
            finish_simple(command[i : i + 2])
            i += 2
        elif c in ";|" or (c == "&" and not command.startswith("&>", i)):
            finish_simple(c)
            i += 1
        elif c == "&":
            i += 1
        elif c.isspace():
            finish_word()
            i += 1
        else:
            word.append(c)
            started = True
            i += 1
    finish_simple("")
    return out


def program(words: list[str]) -> list[str]:
    """The words from the program on: assignments, wrappers and their options left out."""
    i = 0
    while i < len(words):
        w = words[i]
        if re.fullmatch(r"[A-Za-z_]\w*=.*", w, re.S) or w in WRAPPERS:
            i += 1
        elif w == "timeout":
            i += 1
            while i < len(words) and (words[i].startswith("-") or re.fullmatch(r"[\d.]+[smhd]?", words[i])):
                i += 1
        elif i and w.startswith("-") and words[i - 1] in WRAPPERS:
            i += 1
        else:
            break
    return words[i:]


def is_code(target: str) -> bool:
    return bool(target) and not target.startswith("/dev/") and not target.lower().endswith(CAPTURE)


def tidy_path(path: str, cwd: str = "") -> str:
    """A path as seen from the project's root."""
    full = posixpath.normpath(posixpath.join(cwd or ROOT, path))
    return full.removeprefix(ROOT + "/")


def _python_code(words: list[str], documents: list[str]) -> list[str]:
    code = list(documents)
    if "-c" in words and words.index("-c") + 1 < len(words):
        code.append(words[words.index("-c") + 1])
    return code


def _runs_tests(prog: list[str], documents: list[str], cwd: str, memory: dict[str, bool]) -> str:
    """The name of the test runner that a program is, or ''."""
    base = posixpath.basename(prog[0])
    if base in RUNNERS or re.fullmatch(r"run_?tests?(?:\.py|\.sh)?", base) or prog[0].endswith("bin/test"):
        return base if base in RUNNERS else "project runner"
    if base == "make" and any(w in ("test", "tests", "check") for w in prog[1:]):
        return "make test"
    if re.fullmatch(r"python[\d.]*", base):
        if "-m" in prog and prog.index("-m") + 1 < len(prog) and prog[prog.index("-m") + 1].split(".")[0] in MODULES:
            return prog[prog.index("-m") + 1].split(".")[0]
        if any(re.search(r"\bassert\b", c) for c in _python_code(prog, documents)):
            return "inline assert"
        for w in prog[1:]:
            if not w.startswith("-"):
                name = posixpath.basename(w)
                if re.fullmatch(r"run_?tests?\.py", name) or w.endswith("bin/test") or (name == "manage.py" and "test" in prog):
                    return "project runner"
                return "own script" if memory.get(tidy_path(w, cwd)) else ""
    return ""


def _edits(prog: list[str], simple: Simple, cwd: str) -> str | None:
    """The file that a simple command edits ('?' if not named), or None."""
    for target in simple.outputs:
        if is_code(target):
            return tidy_path(target, cwd)
    base = posixpath.basename(prog[0]) if prog else ""
    names = [w for w in prog[1:] if not w.startswith("-")]
    if base == "tee":
        return next((tidy_path(w, cwd) for w in names if is_code(w)), None)
    if base in ("sed", "perl") and any(re.match(r"-[a-zA-Z]*i|--in-place", w) for w in prog[1:]):
        return tidy_path(names[-1], cwd) if len(names) > 1 or (names and any(w in ("-e", "-f") for w in prog)) else "?"
    if base == "patch" or base in EDITORS or prog[:2] == ["git", "apply"]:
        return tidy_path(names[0], cwd) if base == "edit" and names and "." in names[0] else "?"
    if re.fullmatch(r"python[\d.]*", base):
        for code in _python_code(prog, simple.documents):
            if m := re.search(r"open\(\s*(?:r?['\"]([^'\"]+)['\"])?[^)]*['\"][wa][b+]?['\"]", code):
                return tidy_path(m[1], cwd) if m[1] else "?"
            if m := re.search(r"(?:Path\(\s*['\"]([^'\"]+)['\"]\s*\))?\.write(?:_text)?\(", code):
                return tidy_path(m[1], cwd) if m[1] else "?"
    return None


def events(command: str, memory: dict[str, bool]) -> Iterator[tuple[str, str, str]]:
    """(kind, target, runner) of the edit and verify events of a command in order.

    memory holds, for files written so far in the run, whether their body asserts something; it is brought up to date.
    A check wins over an edit in one simple command.
    """
    cwd = ROOT
    for simple in read(command):
        prog = program(simple.words)
        if prog and prog[0] == "cd" and len(prog) > 1:
            cwd = posixpath.normpath(posixpath.join(cwd, prog[1]))
            continue
        for target in simple.outputs:
            if simple.documents and is_code(target):
                memory[tidy_path(target, cwd)] = any(re.search(r"\bassert\b", d) for d in simple.documents)
        runner = _runs_tests(prog, simple.documents, cwd, memory) if prog else ""
        if runner:
            yield "verify", "", runner
        elif (target := _edits(prog, simple, cwd)) is not None:
            yield "edit", target, ""


# ---- outcomes of checks

_COUNT = re.compile(r"(\d+) (passed|failed|errors?|skipped|xfailed|xpassed)\b")
_UNITTEST = re.compile(r"(?m)^(OK|FAILED)(?: \(([^)]*)\))?\s*$")
_ERROR = re.compile(r"(?m)^(?:E\s+)?([A-Za-z_][\w.]*(?:Error|Exception|Warning|Exit|Interrupt))\b")
# fixed values: what in an output says that the surroundings are at fault, not the code
_ENVIRONMENT = ("no module named", "modulenotfounderror", "command not found", "no such file or directory", "permission denied", "cannot import name", "importerror", "connection refused", "can't open file", "is not installed", "unrecognized arguments", "usage:")
_TIMEOUT = ("timed out", "timeoutexpired", "timeout:")


def outcome(output: str | None, runner: str) -> str:
    """pass, fail, error_env, error_code, script_ok, script_fail or unknown, of a check's whole output.

    Counted results win over everything; a failure over an error in the same summary; what stopped the run before any
    result tells an error. Own scripts and inline asserts are judged by their end.
    """
    text = output or ""
    code = int(m[1]) if (m := re.match(r"returncode: (-?\d+)", text)) else 0
    low = text.lower()
    own = runner in ("own script", "inline assert")
    if any(t in low for t in _TIMEOUT):
        return "unknown"
    counts: dict[str, int] = {}
    for number, what in _COUNT.findall(text):
        counts[what.rstrip("s") if what.startswith("error") else what] = int(number)
    if counts and not own:
        if counts.get("failed"):
            return "fail"
        if counts.get("error"):
            return "error_env" if any(e in low for e in _ENVIRONMENT) else "error_code"
        return "pass" if counts.get("passed") or counts.get("xfailed") else "unknown"
    if (m := _UNITTEST.search(text)) and not own:
        if m[1] == "OK":
            return "pass"
        return "fail" if "failures" in (m[2] or "") else "error_env" if any(e in low for e in _ENVIRONMENT) else "error_code"
    failed = code != 0 or "Traceback (most recent call last)" in text
    if own:
        asserted = "AssertionError" in text
        if failed and not asserted and any(e in low for e in _ENVIRONMENT):
            return "error_env"
        return "script_fail" if failed else "script_ok"
    if any(e in low for e in _ENVIRONMENT):
        return "error_env"
    if failed or _ERROR.search(text):
        return "error_code"
    return "unknown"


# fixed values: how domain tools that read and that change something begin
READ_VERBS = ("get", "show", "list", "search", "find", "calculate", "check", "view", "read")
SILENT = ("login", "complete_task", "message", "think", "transfer_to_human_agents")


def tool_kind(name: str, app: str = "") -> tuple[str | None, str | None]:
    """(read, edit or None, app) of a domain tool call such as app__verb_object."""
    head, gap, verb = name.partition("__")
    app, verb = (head, verb) if gap else (app, name)
    if verb in SILENT or app == "supervisor" or not re.fullmatch(r"[a-z0-9_]+", verb):
        return None, None
    return ("read" if verb.split("_")[0] in READ_VERBS else "edit"), app
