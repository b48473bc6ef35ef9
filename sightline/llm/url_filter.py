"""URL filter: rules first, then naive Bayes over segmented host and path words.

* Rules name a host and a path; the longest that fits decides.
* Words of paths and page texts are counted over all rows; host names aren't, since they are what
  is to be split.  A Viterbi search splits concatenated names into the most likely words of that
  unigram model; unknown words cost more with every letter.
* Multinomial naive Bayes, fitted on the rows that rules decide, judges the others.

Both models are whole and nothing of them is broadcast: the unigram counts are joined to the
substrings of each distinct run of letters, the naive Bayes weights to the words of each distinct
run, and runs to the pages that hold them, by sorted joins.

Defined cases: a null url, or one without ``://``, has an empty host and path and is judged by the
method; without any decided row the method allows; ties allow; repeated rows are judged alike; a
null id is passed through; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm import kernels as K
from sightline.plans.store import materialize

CHUNK = 50_000
#: verdict, host, path prefix, as shown in the result.
RULES = [("allow", "org", "/", "org/"), ("block", "example.org", "/es/", "example.org/es/"), ("block", "example.org", "/en/1", "example.org/en/1"), ("allow", "com", "/fr/", "com/fr/"), ("block", "com", "/de/", "com/de/")]
_runs = re.compile(r"[a-z]+|[0-9]+|[^\W\d_a-z]+")


def host_of(url: str = "url") -> Column:
    raw = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: str = "url") -> Column:
    return F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, null if none fits."""
    shown, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for told, host, path, name in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[3])):
        fits = ((F.col("host") == host) | F.endswith(F.col("host"), F.lit("." + host))) & F.startswith(F.col("path"), F.lit(path))
        shown, verdict = F.when(fits, F.lit(name)).otherwise(shown), F.when(fits, F.lit(told)).otherwise(verdict)
    return shown, verdict


class Segmenter:
    """Most likely split of a run of letters under a unigram model, words of any length.

    A known word costs the negative logarithm of its share; an unknown one as much as a word seen
    once, and ln 10 for each letter.  Of equal costs, the longer last word wins.
    """

    LETTER = math.log(10.0)

    def __init__(self, counts: dict[str, int], total: int | None = None):
        self.total = max(1, sum(counts.values()) if total is None else total)
        self.cost = {w: -math.log(c / self.total) for w, c in counts.items()}
        self.lengths = sorted(set(map(len, counts)))

    def split(self, run: str) -> tuple[str, ...]:
        best, back = [0.0], [0]
        open_, since = 0.0, 0  # the cheapest start of an unknown word, less its letters so far
        for i in range(1, len(run) + 1):
            cost, at = open_ + math.log(self.total) + self.LETTER * i, since
            for n in self.lengths:
                if n > i:
                    break
                known = self.cost.get(run[i - n : i])
                if known is not None and (best[i - n] + known, i - n) < (cost, at):
                    cost, at = best[i - n] + known, i - n
            best.append(cost)
            back.append(at)
            if cost - self.LETTER * i < open_:
                open_, since = cost - self.LETTER * i, i
        words, i = [], len(run)
        while i:
            words.append(run[back[i] : i])
            i = back[i]
        return tuple(reversed(words))


def marked_runs(host: str, path: str) -> list[str]:
    """Runs of letters, marked by where they are, in order; a run of digits is a ``#``."""
    return [mark + ("#" if run[0].isdigit() else run) for mark, text in (("h:", host), ("p:", path.lower())) for run in _runs.findall(text)]


def _with_runs(batches):
    for batch in batches:
        runs = [marked_runs(h, p) for h, p in zip(batch["host"].to_pylist(), batch["path"].to_pylist(), strict=True)]
        yield batch.append_column("runs", pa.array(runs, pa.list_(pa.string())))


def _substrings(lengths: list[int]):
    """(id, word) of the distinct substrings of each run that are as long as some known word."""

    def run(batches):
        for batch in batches:
            ids, words = [], []
            for i, marked in zip(batch["id"].to_pylist(), batch["marked"].to_pylist(), strict=True):
                own = marked[2:]
                for n in lengths:
                    if n > len(own):
                        break
                    found = {own[a : a + n] for a in range(len(own) - n + 1)}
                    ids += [i] * len(found)
                    words += found
                    if len(ids) >= CHUNK:
                        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(words, pa.string())], names=["id", "word"])
                        ids, words = [], []
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(words, pa.string())], names=["id", "word"])

    return run


def _cut(total: int):
    def run(batches):
        for batch in batches:
            words = []
            for marked, known in zip(batch["marked"].to_pylist(), batch["known"].to_pylist(), strict=True):
                cut = ("#",) if marked[2:] == "#" else Segmenter({k["word"]: k["n"] for k in known or ()}, total).split(marked[2:])
                words.append([marked[:2] + w for w in cut])
            yield batch.drop_columns(["known"]).append_column("words", pa.array(words, pa.list_(pa.string())))

    return run


def filter_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, p_block, words) of every row of (page_id, url)."""
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of().alias("host"), path_of().alias("path"))
    shown, told = rule_of(rules)
    base = base.select(F.monotonically_increasing_id().alias("row"), "page_id", "host", "path", shown.alias("rule"), told.alias("told"))
    rows = materialize(base.mapInArrow(_with_runs, "row long, page_id long, host string, path string, rule string, told string, runs array<string>"), "urls")
    slots = rows.select("row", "told", F.posexplode("runs").alias("at", "marked"))
    blocks = F.coalesce(F.sum((F.col("told") == "block").cast("long")), F.lit(0)).alias("block")
    runs = materialize(slots.groupBy("marked").agg(F.count("told").alias("n"), blocks).withColumn("id", F.monotonically_increasing_id()), "runs")

    seen_text = [F.lower(path_of())] + ([F.lower(F.regexp_replace("html", "<[^>]*>", " "))] if "html" in pages.columns else [])
    said = pages.select(F.explode(F.regexp_extract_all(F.concat_ws(" ", *seen_text), F.lit("[a-z]+"), F.lit(0))).alias("word"))
    unigrams = materialize(said.groupBy("word").agg(F.count("*").alias("n")), "counts")
    total = unigrams.agg(F.sum("n")).first()[0] or 0
    lengths = sorted(r[0] for r in unigrams.select(F.length("word")).distinct().collect())
    latin = runs.filter(F.col("marked").rlike("^..[a-z]")).select("id", "marked")
    known = latin.mapInArrow(_substrings(lengths), "id long, word string").join(unigrams.hint("merge"), "word").groupBy("id").agg(F.collect_list(F.struct("word", "n")).alias("known"))
    cut = runs.join(known.hint("merge"), "id", "left").select("id", "marked", "n", "block", "known")
    cut = materialize(cut.mapInArrow(_cut(total), "id long, marked string, n long, block long, words array<string>"), "words")

    words = cut.select("id", "n", "block", F.posexplode("words").alias("at", "word"))
    seen = materialize(words.filter("n > 0").groupBy("word").agg(F.sum("n").alias("n"), F.sum("block").alias("block")), "seen")
    size, block, allow = (x or 0 for x in seen.agg(F.count("*"), F.sum("block"), F.sum(F.col("n") - F.col("block"))).first())
    weight = F.log((F.col("block") + 1) / (block + size + 1)) - F.log((F.col("n") - F.col("block") + 1) / (allow + size + 1))
    n = {r["told"]: r["count"] for r in rows.filter("told is not null").groupBy("told").count().collect()}
    prior = math.log(n["block"] / n["allow"]) if n.get("block") and n.get("allow") else (math.inf if n.get("block") else -math.inf)
    weighed = words.select("id", "at", "word").join(seen.select("word", weight.alias("weight")).hint("merge"), "word", "left")
    weighed = weighed.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("at", "word", F.coalesce("weight", F.lit(0.0)).alias("weight")))).alias("tokens"))
    found = slots.select("row", "at", "marked").join(cut.select("id", "marked").join(weighed.hint("merge"), "id").drop("id").hint("merge"), "marked")
    found = found.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("at", "tokens"))).alias("runs"))  # in order, so that sums are alike
    tokens = F.flatten(F.transform("runs", lambda r: r["tokens"]))
    found = found.select("row", F.transform(tokens, lambda t: t["word"]).alias("words"), F.transform(tokens, lambda t: t["weight"]).alias("weights"))
    out = "page_id long, host string, path string, rule string, verdict string, p_block double"
    out_schema = pa.schema([*K.columns(out), ("words", pa.list_(pa.string()))])

    def judge(batches):
        for batch in batches:
            odds = [prior + sum(ws or ()) for ws in batch["weights"].to_pylist()]
            verdict = [t or ("block" if o > 0 else "allow") for t, o in zip(batch["told"].to_pylist(), odds, strict=True)]
            p = [1.0 / (1.0 + math.exp(-max(-700.0, min(700.0, o)))) for o in odds]
            words = pa.array([ws or [] for ws in batch["words"].to_pylist()], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch["page_id"], batch["host"], batch["path"], batch["rule"], pa.array(verdict, pa.string()), pa.array(p, pa.float64()), words], schema=out_schema)

    return rows.drop("runs").join(found.hint("merge"), "row", "left").mapInArrow(judge, out + ", words array<string>")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))
