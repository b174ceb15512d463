"""Column functions on slash-separated relative paths, and ignore rules as regular expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def directory(path: Column) -> Column:
    """The parent; "." for what lies at the root."""
    return F.when(path.contains("/"), F.regexp_extract(path, "^(.*)/[^/]*$", 1)).otherwise(".")


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def depth(directory_path: Column) -> Column:
    return F.when(directory_path == ".", 0).otherwise(F.size(F.split(directory_path, "/")))


def ancestors(path: Column) -> Column:
    """All directories above a path, the root "." first."""
    parts = F.split(path, "/")
    return F.concat(F.array(F.lit(".")), F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).otherwise(F.array().cast("array<string>")))


def with_ancestors(directory_path: Column) -> Column:
    """A directory and all above it."""
    return F.when(directory_path == ".", F.array(F.lit("."))).otherwise(F.concat(ancestors(directory_path), F.array(directory_path)))


def hidden(path: Column) -> Column:
    return F.exists(F.split(path, "/"), lambda c: c.startswith(".") | c.endswith(".egg-info"))


def page(directory_path: Column) -> Column:
    return F.when(directory_path.isin("", "."), "README.md").otherwise(F.concat(directory_path, F.lit("/README.md")))


def escapes(path: Column) -> Column:
    """Whether the path, taken from the root, leads outside: the lexical part of the guard."""
    down = F.aggregate(
        F.filter(F.split(F.regexp_replace(path, "^/+", ""), "/"), lambda c: ~c.isin("", ".")),
        F.struct(F.lit(0).alias("level"), F.lit(False).alias("out")),
        lambda s, c: F.struct(F.when(c == "..", F.greatest(s["level"] - 1, F.lit(0))).otherwise(s["level"] + 1).alias("level"), (s["out"] | ((c == "..") & (s["level"] == 0))).alias("out")),
    )
    return down["out"]


def ignore_regex(rule: str) -> tuple[str, bool] | None:
    """A rule as (regular expression, whether it includes again); None for blank lines and comments.

    Rules are as in .gitignore: `*` and `?` stay within a component, `**` does not, a slash before the end anchors,
    a slash at the end asks for a directory, `!` includes again.
    """
    rule = rule.rstrip("\r\n").strip()
    if not rule or rule.startswith("#"):
        return None
    again = rule.startswith("!")
    rule = rule[again:]
    rule = rule[1:] if rule.startswith(("\\#", "\\!")) else rule
    below = rule.endswith("/")
    rule = rule.rstrip("/")
    anchored = "/" in rule
    rule = rule.lstrip("/")
    out, i = "", 0
    while i < len(rule):
        if rule.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif rule.startswith("/**", i) and i + 3 == len(rule):
            out, i = out + "/.*", i + 3
        elif rule[i] == "*":
            while rule.startswith("*", i):
                i += 1
            out += "[^/]*"
        elif rule[i] == "?":
            out, i = out + "[^/]", i + 1
        elif rule[i] == "[" and (j := rule.find("]", i + 1)) > 0:
            inside = rule[i + 1 : j].replace("\\", "\\\\")
            out, i = out + f"[{'^' + inside[1:] if inside.startswith('!') else inside}]", j + 1
        else:
            out, i = out + re.sub(r"([.^$+{}()|\\\[\]])", r"\\\1", rule[i]), i + 1
    return f"^{'' if anchored else '(?:.*/)?'}{out}{'/.*' if below else '(?:/.*)?'}$", again


def _merged(rules: list[str]) -> list[tuple[str, bool]]:
    """(regular expression, whether it includes again): neighbours of one kind as one expression, so that a path is matched once for each change of kind."""
    out: list[tuple[list[str], bool]] = []
    for pattern, again in filter(None, map(ignore_regex, rules)):
        if out and out[-1][1] == again:
            out[-1][0].append(pattern)
        else:
            out.append(([pattern], again))
    return [("|".join(x), again) for x, again in out]


def ignored(path: Column, rules: list[str]) -> Column:
    """Whether the last matching rule ignores the path, or it is hidden."""
    out = F.lit(False)
    for pattern, again in _merged(rules):
        out = F.when(path.rlike(pattern), F.lit(not again)).otherwise(out)
    return out | hidden(path)


def ignored_by(rules: list[str]):
    """The same as a Python predicate, for the scan."""
    made = [(re.compile(pattern), again) for pattern, again in _merged(rules)]

    def test(path: str) -> bool:
        out = False
        for pattern, again in made:
            if pattern.match(path):
                out = not again
        return out or any(c.startswith(".") or c.endswith(".egg-info") for c in path.split("/"))

    return test


def never_entered(directory_path: Column, rules: list[str]) -> Column:
    """Whether a scan leaves the directory out, and with it all that lies below; a rule for directories names what lies below."""
    return ignored(directory_path, rules) | ignored(F.concat(directory_path, F.lit("/x")), rules)


def pruned(path: Column, rules: list[str]) -> Column:
    """Whether the path or a directory above it is ignored, path by path; unignored() judges each directory once."""
    above = F.filter(ancestors(path), lambda d: d != ".")
    return F.exists(above, lambda d: never_entered(d, rules)) | ignored(path, rules)
