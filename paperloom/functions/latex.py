"""LaTeX of recognised formulas: cleaning and Markdown, as column expressions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Commands that mean nothing with an empty group, blanks that mean nothing at the end, signs that no backslash goes with.
ACCENTS = ["hat", "text", "tilde", "bar", "vec", "acute", "grave", "breve", "overline", "dot", "ddot", "widehat", "widetilde"]
BLANKS = [r"\\ +", r"\\quad\s*", r"\\qquad\s*", r"\\,\s*", r"\\:\s*", r"\;\s*", r"\\enspace\s*", r"\\thinspace\s*", r"\\!\s*"]
PLAIN_SIGNS = ".=~-"

_EMPTY = r"(?:\\(?:" + "|".join(ACCENTS) + r")|\^|_)\s*\{\s*\}"
_SPACE = r"^\s+|\s+$"


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, _SPACE, "")


def without_leading_script(text: Column) -> Column:
    """The group of a script that a text starts with in place of the script."""
    out = text
    for sign in (r"\^", "_"):
        out = F.regexp_replace(out, rf"(?s)^{sign}\s*\{{\s*(.*?)\s*\}}(?=(.*)$)", "$1")
    return trimmed(out)


def without_empty_groups(text: Column, depth: int = 1) -> Column:
    """Without accents and scripts of empty groups; depth passes, as groups nest."""
    out = text
    for _ in range(depth):
        out = trimmed(F.regexp_replace(out, _EMPTY, ""))
    return out


def without_trailing_blanks(text: Column) -> Column:
    return trimmed(F.regexp_replace(text, "(?:" + "|".join(BLANKS) + ")+$", ""))


def legal_signs(text: Column) -> Column:
    """A space between a backslash and a sign that is no command."""
    return F.regexp_replace(text, rf"\\([{PLAIN_SIGNS}])", r"\\ $1")


_SIDES = re.compile(r"\\(left|right)(?=\s*[^\sA-Za-z])\s*(\\[A-Za-z]+|\\?\S)")


def _paired(text: str) -> str:
    opened: list[tuple[int, str]] = []
    bare: list[int] = []
    rights = [(m.start(), m[2]) for m in _SIDES.finditer(text) if m[1] == "right"]
    for m in _SIDES.finditer(text):
        if m[1] == "left":
            opened.append((m.start(), m[2]))
    used: set[int] = set()
    for at, own in opened:
        fit = next((r for r, other in rights if r > at and r not in used and _fits(own, other)), None)
        if fit is None:
            bare.append(at)
        else:
            used.add(fit)
    gone = {at: 5 for at in bare} | {r: 6 for r, _ in rights if r not in used}
    for at, n in gone.items():
        text = text[:at] + " " * n + text[at + n :]
    return re.sub(r"\s+", " ", text).strip()


#: Commands that open no pair although they may follow a side.
_NO_DELIMITERS = {"frac", "sqrt", "sum", "int", "text", "mathrm"}


def _fits(left: str, right: str) -> bool:
    """Signs fit any sign, commands those that differ from them by l and r in front only (or not at all); a dot fits everything."""
    if "." in (left, right):
        return True
    names = [x[1:] if re.match(r"\\[A-Za-z]", x) else "" for x in (left, right)]
    if not all(names):
        return not any(names)
    return names[0][1:] == names[1][1:] and (names[0][0] + names[1][0]).lower() == "lr" or names[0] == names[1] and names[0] not in _NO_DELIMITERS


def paired_sides(text: Column) -> Column:
    r"""Without \left and \right that have no partner; runs of white space become one space. Null stays null."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(_paired, na_action="ignore")

    return run(text)


def tight(text: Column) -> Column:
    """Without spaces that LaTeX ignores: after commands, within braces, around + - = and scripts."""
    out = F.regexp_replace(text, r"\\([a-zA-Z]+)\s+(?![a-zA-Z])", r"\\$1")
    out = F.regexp_replace(F.regexp_replace(out, r"\{\s+", "{"), r"\s+\}", "}")
    out = F.regexp_replace(out, r"(?<=[^\\])\s*([+\-=])\s*", "$1")
    return F.regexp_replace(out, r"\s*([\^_])\s*", "$1")


def tidy(text: Column) -> Column:
    """All of the above, in the order of a recogniser's post-processing."""
    out = legal_signs(without_trailing_blanks(without_leading_script(text)))
    return trimmed(tight(paired_sides(without_empty_groups(out, 10))))


def _squeezed(text: Column, opener: str) -> Column:
    """Without spaces between each opener and the next closing brace."""
    parts = F.split(text, F.lit(re.sub(r"([\\{])", r"\\\1", opener)))
    last = F.size(parts) - 1

    def part(x, i):
        end = F.instr(x, "}")
        tight_ = F.concat(F.replace(F.left(x, end), F.lit(" "), F.lit("")), F.substr(x, end + 1))
        return F.when(i == 0, x).when(end > 0, tight_).when(i < last, F.replace(x, F.lit(" "), F.lit(""))).otherwise(x)

    return F.array_join(F.transform(parts, part), opener)


def to_markdown(text: Column) -> Column:
    r"""An inline Markdown formula: \mathrm names in braces without spaces, tight indices, commas and minus signs."""
    out = F.regexp_replace(text, r"\\mathrm\s+([A-Za-z ]+)(?![^{}]*\})", r"\\mathrm{$1}")
    out = _squeezed(out, "\\mathrm{")
    out = F.regexp_replace(out, r"\\mathrm\{([^}]*)\}(\s*)(\d+)", r"\\mathrm{$1$3}")
    out = _squeezed(out, "_{")
    out = F.regexp_replace(F.regexp_replace(out, r",\s+", ","), r"\s*-\s*", "-")
    out = trimmed(out)
    return F.when(out.endswith(".)"), F.concat(F.lit("$"), F.regexp_replace(out, r"[).]+$", ""), F.lit(".)$"))).otherwise(F.concat(F.lit("$"), out, F.lit("$")))


def is_cjk(char: Column) -> Column:
    return char.between("\u4e00", "\u9fff")


def smart_joined(parts: Column) -> Column:
    """Texts joined by a space, but by nothing between two CJK characters or beside white space. Null and empty parts are left out."""

    def add(done, new):
        last, first = F.right(done, F.lit(1)), F.left(new, F.lit(1))
        bare = (is_cjk(last) & is_cjk(first)) | F.concat(last, first).rlike(r"\s")
        return F.when(done == "", new).when(bare, F.concat(done, new)).otherwise(F.concat(done, F.lit(" "), new))

    kept = F.filter(parts, lambda p: p.isNotNull() & (p != ""))
    return F.aggregate(kept, F.lit(""), add)


def cleaned_heading(text: Column, noise: Column | str = " *单位.*?(?:人迷你|美元)") -> Column:
    """A heading without the table remark on its line; the pattern is a parameter, the default a fixed value."""
    return F.regexp_replace(text, F.lit(noise) if isinstance(noise, str) else noise, F.lit(""))
