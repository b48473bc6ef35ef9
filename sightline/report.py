"""Reports: Markdown from small frames, marked parts of documents, and what a run was made of."""

from __future__ import annotations

import hashlib
import importlib.metadata
import re
import subprocess
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def rounded(value, decimals: int = 3):
    """Rounded as Python does, on the driver; None stays."""
    return None if value is None else round(float(value), decimals)


def table(df: DataFrame, order: list[str], limit: int = 10_000, decimals: int = 3) -> str:
    """A Markdown table of a small frame; raises beyond ``limit`` rows rather than cutting it."""
    rows = df.orderBy(*order).limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"a report table has more than {limit} rows")
    show = lambda v: "-" if v is None else str(round(v, decimals)) if isinstance(v, float) else str(v).replace("|", "\\|")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(show(v) for v in r) + " |" for r in rows])


class MarkerError(ValueError):
    """A document's markers don't enclose exactly one part."""


def replace_marked(text: str, start: str, end: str, body: str) -> str:
    """``text`` with ``body`` on lines of its own between two markers; all else stays as it is."""
    seen = [m.group() for m in re.finditer(f"{re.escape(start)}|{re.escape(end)}", text)]
    if seen != [start, end]:
        raise MarkerError(f"the part needs the markers {[start, end]}, the text has {seen}")
    before, _, rest = text.partition(start)
    return "".join([before, start, "\n", body, "\n", end, rest.partition(end)[2]])


def write_marked(path: Path, start: str, end: str, body: str) -> bool:
    """Rewrites a marked part; whether that changed the file."""
    old = path.read_text(encoding="utf-8")
    new = replace_marked(old, start, end, body)
    if new != old:
        path.write_text(new, encoding="utf-8")
    return new != old


def _git(repo: Path, *args: str) -> str | None:
    done = subprocess.run(["git", "-C", str(repo), *args], capture_output=True, text=True)
    return done.stdout.strip() if done.returncode == 0 else None


def provenance(repo: Path, packages: list[str], files: list[Path] = (), allow_dirty: bool = True) -> dict:
    """Commit, cleanliness, package versions and file hashes of a run; a dirty tree is refused unless allowed."""
    dirty = bool(_git(repo, "status", "--porcelain"))
    if dirty and not allow_dirty:
        raise RuntimeError("the working tree has changes that aren't committed")

    def version(name: str) -> str | None:
        try:
            return importlib.metadata.version(name)
        except importlib.metadata.PackageNotFoundError:
            return None

    return {"created": datetime.now(UTC).isoformat(timespec="seconds"), "commit": _git(repo, "rev-parse", "HEAD"), "dirty": dirty, "packages": {p: version(p) for p in packages}, "files": {str(f): hashlib.sha256(Path(f).read_bytes()).hexdigest() for f in files}}


class Redactor:
    """Replaces a secret in whatever is written or logged."""

    def __init__(self, secret: str | None, shown: str = "***"):
        self.secret, self.shown = secret, shown

    def __call__(self, text: str) -> str:
        return text.replace(self.secret, self.shown) if self.secret else text

    def filter(self, record) -> bool:
        record.msg, record.args = self(record.getMessage()), ()
        return True


LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ_"


def _prose(line: Column) -> Column:
    """A line without its code spans, link targets and addresses."""
    parts = F.split(line, "`")
    open_ = F.size(parts) - 1  # after an odd number of ticks, the last one opens nothing
    outside = F.filter(parts, lambda x, i: (i % 2 == 0) | ((i == open_) & (open_ % 2 == 1)))
    linked = F.split(F.array_join(outside, ""), r"\]\(")
    # what follows "](" counts from its closing bracket on
    shown = F.transform(linked, lambda x, i: F.when((i == 0) | ~F.contains(x, F.lit(")")), x).otherwise(F.array_join(F.slice(F.split(x, r"\)"), 2, 1 << 30), ")")))
    words = F.split(F.array_join(shown, "] "), r"\s+")
    return F.array_join(F.transform(words, lambda w: F.when(F.contains(w, F.lit("://")), F.substring_index(F.substring_index(w, "https://", 1), "http://", 1)).otherwise(w)), " ")


def numbers_in(line: Column) -> Column:
    """The decimals and percentages of a text, each as it is written, units and final stops cut off.

    A token of letters, digits, stops and percent signs counts if it is digits with one stop among
    them, or digits with a percent sign at the end; so versions, names and dates don't.
    """
    tokens = F.split(line, r"[^0-9A-Za-z_.%]+")
    bare = F.transform(tokens, lambda t: F.rtrim(F.rtrim(t, F.lit(".")), F.lit(LETTERS)))

    def counts(t: Column) -> Column:
        parts = F.split(F.rtrim(t, F.lit("%")), r"\.")
        digits = F.forall(parts, lambda x: x.rlike("^[0-9]+$"))
        percent = F.endswith(t, F.lit("%")) & (F.size(parts) <= 2) & ~F.contains(t, F.lit("%%"))
        return digits & (percent | ((F.size(parts) == 2) & ~F.contains(t, F.lit("%"))))

    return F.filter(bare, counts)


def unsourced_numbers(docs: DataFrame, sources: DataFrame, ignore: str = "numbers: ok") -> DataFrame:
    """(path, line, number) of decimals and percentages in documents that no source holds.

    Both tables have (path, line, text).  Fenced blocks, code spans, link targets, comments,
    versions and lines with the mark are left out.
    """
    lead = F.substring(F.ltrim("text"), 1, 4)
    kind = F.when(F.substring(lead, 1, 3).isin("```", "~~~"), "fence").when((lead == "<!--") | F.contains("text", F.lit(ignore)), "mute").otherwise("prose")
    rows = docs.withColumn("kind", kind)
    fences = F.count_if(F.col("kind") == "fence").over(W.partitionBy("path").orderBy("line").rowsBetween(W.unboundedPreceding, W.currentRow))
    read = rows.withColumn("fences", fences).filter("kind = 'prose' and fences % 2 = 0")
    found = read.select("path", "line", F.explode(numbers_in(_prose(F.col("text")))).alias("number"))
    known = sources.select(F.explode(numbers_in(F.col("text"))).alias("number")).distinct()
    return found.join(known, "number", "left_anti").select("path", "line", "number")
