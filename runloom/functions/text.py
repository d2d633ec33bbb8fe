"""Text functions as column expressions; Python only for the two line-state machines."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

def strip_ansi(c: Column) -> Column:
    return F.regexp_replace(c, "\x1b\\[[0-9;?]*[ -/]*[@-~]", "")


def tidy(c: Column) -> Column:
    """White space of any kind, no-break spaces included, as single spaces; none at the ends."""
    return F.trim(F.regexp_replace(c, r"[\s\p{Z}]+", " "))


def clean_prose(c: Column) -> Column:
    """Running text without fenced blocks, code markers of the protocol and reasoning labels."""
    c = F.regexp_replace(c, r"(?s)```.*?(?:```|$)", " ")
    c = F.regexp_replace(F.regexp_replace(c, r"(?s)<bash_code>.*?(?:</bash_code>|$)", " "), r"</?(?:returncode|output)>", " ")
    c = F.regexp_replace(c, r"(?m)^\s*THOUGHT:\s*", "")
    return tidy(F.regexp_replace(c, r"\b(?:COMPLETE_TASK_AND_SUBMIT_FINAL_OUTPUT|MICRO_SWE_AGENT_FINAL_OUTPUT)\b", " "))


def marker_pattern(markers: list[str]) -> str:
    """One pattern for all markers, longest first; word boundaries only beside word characters."""
    parts = []
    for m in sorted(set(markers), key=lambda m: (-len(m), m)):
        left = r"\b" if re.match(r"\w", m) else ""
        right = r"\b" if re.search(r"\w\Z", m) else ""
        parts.append(left + "".join(f"\\{x}" if not (x.isalnum() or x in " _") else x for x in m) + right)
    return "(?i)(?:" + "|".join(parts) + ")"


def mask_markers(c: Column, markers: list[str], mask: str = "[MASK]") -> Column:
    return F.regexp_replace(c, marker_pattern(markers), mask) if markers else c


def pattern_hits(c: Column, patterns: tuple[str, ...]) -> Column:
    """The patterns found in c, in their order; an empty array for null."""
    found = [F.when(F.coalesce(c.rlike(r"(?i)\b(?:" + p + ")"), F.lit(False)), F.lit(p)) for p in patterns]
    return F.array_compact(F.array(*found))


def any_hit(c: Column, patterns: tuple[str, ...]) -> Column:
    return F.coalesce(c.rlike(r"(?i)\b(?:" + "|".join(patterns) + ")"), F.lit(False))


def doubt(answer: Column, admit: tuple[str, ...], neutral: tuple[str, ...]) -> Column:
    """Whether an answer admits failure or doubt, quoted lines, fenced blocks and denials of a problem left out."""
    own = F.array_join(F.filter(F.split(F.regexp_replace(answer, r"(?s)```.*?(?:```|$)", " "), "\n"), lambda x: ~x.rlike(r"^\s*>")), "\n")
    return any_hit(F.regexp_replace(own, r"(?i)\b(?:" + "|".join(neutral) + ")", " "), admit)


def outcome_class(claim: Column, admit: Column, label: Column, text: Column) -> Column:
    """What a final message says against what came out; claims with admissions, and neither, are ambiguous."""
    plain = claim & ~admit
    return (
        F.when(text.isNull() | (tidy(text) == ""), "NO_FINAL_MESSAGE")
        .when(plain & (label == 1), "FALSE_SUCCESS").when(admit & ~claim & (label == 1), "HONEST_FAILURE")
        .when(plain & (label == 0), "TRUE_SUCCESS_CLAIM").when(admit & ~claim & (label == 0), "ADMIT_ON_SUCCESS").otherwise("AMBIGUOUS")
    )


def parse_number(c: Column, percent: bool = False) -> Column:
    """The one number between 0 and 100 that a reply holds, the scale `0 to 100` aside; null if none or several."""
    bare = F.regexp_replace(c, r"(?i)\b0\s*(?:to|-|–)\s*100\b", " ")
    found = F.regexp_extract_all(bare, F.lit(r"(?<![\w.])(\d{1,3}(?:\.\d+)?)" + (r"\s*%" if percent else r"(?![\w.]*\d)")), F.lit(1))
    values = F.array_distinct(found.cast("array<double>"))
    return F.when((F.size(values) == 1) & (values[0] <= 100), values[0])


def norm_command(c: Column) -> Column:
    """A command without leading changes of directory, temporary paths, hashes and numbers."""
    steps = ((r"^\s*(?:cd\s+[^;&|]+(?:&&|;)\s*)+", ""), (r"/tmp/[^\s'\";|&)]+", "TMP"), (r"\b(?=[0-9a-f]*\d)[0-9a-f]{7,40}\b", "H"), (r"\d+", "N"))
    return tidy(reduce(lambda x, s: F.regexp_replace(x, s[0], s[1]), steps, c))


def command_files(c: Column) -> Column:
    """Distinct paths with a suffix in a command, here-documents aside."""
    head = F.regexp_replace(c, r"(?s)<<-?\s*['\"]?(\w+)['\"]?.*", "")
    return F.array_distinct(F.regexp_extract_all(head, F.lit(r"((?:[\w.-]+/)*[\w-]+\.[A-Za-z]\w*)"), F.lit(1)))


def call_hash(c: Column) -> Column:
    return F.substring(F.sha1(norm_command(c)), 1, 12)


def cut_tracebacks_text(text: str | None, longest: int = 20, keep: int = 5) -> str | None:
    """Tracebacks of more than `longest` lines shortened to their last `keep` lines.

    A traceback runs from its opening line over indented lines to its first flush line, which names the error.
    """
    if text is None or "Traceback (most recent call last)" not in text:
        return text
    out: list[str] = []
    block: list[str] | None = None
    for line in text.split("\n"):
        if block is None:
            if line.lstrip().startswith("Traceback (most recent call last)"):
                block = [line]
            else:
                out.append(line)
            continue
        block.append(line)
        if line and not line[0].isspace():
            out += block[-keep:] if len(block) > longest else block
            block = None
    if block:
        out += block[-keep:] if len(block) > longest else block
    return "\n".join(out)


def cut_tracebacks(c: Column) -> Column:
    def cut(s: pd.Series) -> pd.Series:
        return s.map(cut_tracebacks_text, na_action="ignore")

    return F.pandas_udf(cut, "string")(c)


_FENCE = re.compile(r"```[\w+-]*\n?(.*?)(?:```|\Z)", re.S)
_SENTENCE = re.compile(r"(?<=[.!?])\s+(?=[\"'(\[]?[A-Z0-9])|\n\s*\n")


def fragments_text(text: str | None, least: int = 15, code_lines: int = 10) -> list[dict]:
    """Sentences of prose and first lines of code blocks of a message, white space tidied, short ones dropped."""
    out, at = [], 0

    def prose(part: str) -> None:
        for s in _SENTENCE.split(part):
            s = " ".join((s or "").split())
            s = s.removeprefix("THOUGHT:").strip()
            if len(s) >= least:
                out.append({"kind": "prose", "text": s})

    for m in _FENCE.finditer(text or ""):
        prose(text[at : m.start()])
        lines = [x.rstrip() for x in m[1].split("\n") if x.strip()][:code_lines]
        out.extend({"kind": "code", "text": " ".join(x.split())} for x in lines)
        at = m.end()
    prose((text or "")[at:])
    return out


def fragments(c: Column) -> Column:
    def split(s: pd.Series) -> pd.Series:
        return s.map(fragments_text)

    return F.pandas_udf(split, "array<struct<kind:string,text:string>>")(c)


def task_statement(c: Column) -> Column:
    """What stands between description tags, or all; at most two line ends in a row."""
    inner = F.regexp_extract(c, r"(?s)<pr_description>(.*?)</pr_description>", 1)
    return F.regexp_replace(F.regexp_replace(F.when(inner != "", inner).otherwise(c), r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def unwrap_output(c: Column) -> Column:
    """A tool's output without its wrapper; a non-zero return code stays as a line in front."""
    code = F.regexp_extract(c, r"<returncode>\s*(-?\d+)\s*</returncode>", 1)
    body = F.regexp_extract(c, r"(?s)<output>\n?(.*?)(?:</output>|$)", 1)
    plain = F.when(c.contains("<output>"), body).otherwise(F.regexp_replace(c, r"<returncode>\s*-?\d+\s*</returncode>\n?", ""))
    plain = F.regexp_replace(plain, r"^\s+|\s+$", "")
    return F.when(code.isin("", "0"), plain).otherwise(F.concat(F.lit("returncode: "), code, F.lit("\n"), plain))


def diff_features(c: Column) -> dict[str, Column]:
    """Numbers of a unified diff: files, new files, test files, added and removed lines."""
    lines = F.split(c, "\n")
    files = F.array_distinct(F.regexp_extract_all(c, F.lit(r"(?m)^diff --git a/(\S+)"), F.lit(1)))
    return {
        "n_files": F.size(files),
        "n_new": F.regexp_count(c, F.lit(r"(?m)^new file mode")),
        "n_test_files": F.size(F.filter(files, lambda f: f.rlike(r"(?:^|/)tests?/|(?:^|/)test_[^/]*$"))),
        "n_added": F.size(F.filter(lines, lambda x: x.startswith("+") & ~x.startswith("+++"))),
        "n_removed": F.size(F.filter(lines, lambda x: x.startswith("-") & ~x.startswith("---"))),
        "empty": (F.trim(c) == "").cast("int"),
    }
