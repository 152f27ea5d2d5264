"""Line-first quality rules: failing lines go, then documents that lose too much text.

A line fails by the first of these rules that it breaks: ``navigation`` (cells between bars),
``symbols`` (words full of markup signs), ``shouting`` (capitals throughout), ``stutter`` (few
different words), ``repeat`` (equal to an earlier line), ``boilerplate`` (phrases of site
furniture), ``punctuation`` (long without any punctuation). A document is kept if it passes the
base limits and the lines that go hold at most ``most_lost`` of its characters.

Defined cases: null text is an empty text, fails the base limits and isn't kept; lines without a
word are neither counted nor removed; repeated rows and ids each get a result; an empty table
gives an empty result.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_slice, slices, texts

SYMBOLS = "#*$%&|<>"
BLANK = " \t\n\r\x0b\x0c"
#: Site furniture, as phrases in lower case.
BOILERPLATE = regex.compile(
    r"\b(?:enable javascript|javascript is (?:disabled|required)|accept (?:all )?cookies|cookie policy|privacy policy|terms of (?:use|service)"
    r"|sign up for our newsletter|subscribe to our newsletter|click here to|skip to (?:main )?content|lorem ipsum)\b",
    regex.IGNORECASE,
)
CELL = re.compile(r"(?:^|\s)[|»›·•](?=\s|$)")
MARKED = re.compile(rf"[{re.escape(SYMBOLS)}]")
PUNCTUATION = regex.compile(r"[\p{P}--[#*%&@\\/_-]]", regex.V1)


class Limits(NamedTuple):
    """The rules' limits; words are runs without ASCII white space."""

    least_words: int = 50
    most_repeated: float = 0.5
    most_lost: float = 0.4
    cells: int = 3
    symbol_words: float = 0.3
    capitals: float = 0.7
    shout_words: int = 4
    stutter_words: int = 12
    stutter_different: float = 0.2
    plain_words: int = 12


def split_words(text: str) -> list[str]:
    return [w.decode("utf-8", "surrogatepass") for w in text.encode("utf-8", "surrogatepass").split()]


def repeated_words(words: list) -> int:
    """Words in some 3-word window that occurs twice or more; exact, in memory linear in the words."""
    n = len(words)
    if n < 4:
        return 0
    number: dict = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    pairs = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)[1]
    _, window, times = np.unique(pairs[:-1] * np.int64(len(number)) + ids[2:], return_inverse=True, return_counts=True)
    again = times[window] > 1
    inside = np.zeros(n, bool)
    for shift in range(3):
        inside[shift : n - 2 + shift] |= again
    return int(inside.sum())


def line_fault(line: str, words: list[str], earlier: bool, limits: Limits) -> str | None:
    n = len(words)
    if len(CELL.findall(line)) >= limits.cells:
        return "navigation"
    if n >= 2 and sum(1 for w in words if MARKED.search(w)) > limits.symbol_words * n:
        return "symbols"
    if n >= limits.shout_words:
        upper = sum(map(str.isupper, line))
        if upper > limits.capitals * max(1, sum(map(str.isalpha, line))):
            return "shouting"
    if n >= limits.stutter_words and len(set(words)) < limits.stutter_different * n:
        return "stutter"
    if earlier:
        return "repeat"
    if BOILERPLATE.search(line):
        return "boilerplate"
    if n >= limits.plain_words and not PUNCTUATION.search(line):
        return "punctuation"
    return None


class Verdict(NamedTuple):
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    base_failed: bool
    kept: bool
    lost: float
    faults: list[str]
    cleaned: str


def judge(text: str | None, limits: Limits = Limits()) -> Verdict:
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    word_chars = len(text) - sum(map(text.count, BLANK))
    repeated = repeated_words(words)
    seen, kept_lines, faults, duplicates, lost, cut = set(), [], [], 0, 0, False
    for line in text.split("\n"):
        if not line.strip(BLANK):
            kept_lines.append(line)
            continue
        earlier = line in seen
        duplicates += earlier
        seen.add(line)
        fault = line_fault(line, split_words(line), earlier, limits)
        if fault:
            faults.append(fault)
            lost += len(line)
            cut = True
        else:
            kept_lines.append(line)
    total = max(1, len(text) - text.count("\n"))
    base_failed = n < limits.least_words or repeated > limits.most_repeated * n
    share = lost / total
    return Verdict(
        n, word_chars, sum(map(text.count, SYMBOLS)), duplicates, repeated, base_failed, not base_failed and share <= limits.most_lost, share, faults,
        "\n".join(kept_lines).strip("\n") if cut else text,
    )


def judge_documents(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(doc_id, the counts, base_failed, kept, lost, faults, cleaned) of every row of docs(doc_id, text)."""
    fields = [
        ("doc_id", pa.int64()), ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()),
        ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("lost", pa.float64()), ("faults", pa.list_(pa.string())), ("cleaned", pa.string()),
    ]

    def run(batch):
        found = [judge(t, limits) for t in batch["text"].to_pylist()]
        return {"doc_id": batch["doc_id"]} | {name: [getattr(v, name) for v in found] for name, _ in fields[1:]}

    kinds = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, lost double, faults array<string>, cleaned string"
    return texts(docs).mapInArrow(per_slice(run, pa.schema(fields)), kinds)


def clean_documents(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The rows that are kept, with failing lines removed from ``text``; other columns as they were.

    ``n_chars``, where there is such a column, follows the text. A null or empty text goes; repeated
    rows and ids are judged each; other columns, whatever their names, play no part; an empty table
    gives an empty one.
    """

    def run(batches):
        for batch in slices(batches):
            found = [judge(t, limits) for t in batch["text"].to_pylist()]
            kept = batch.filter(pa.array([v.kept for v in found], pa.bool_()))
            new = [v.cleaned for v in found if v.kept]
            columns = {name: kept[name] for name in kept.schema.names} | {"text": pa.array(new, kept.schema.field("text").type)}
            yield pa.RecordBatch.from_pydict(columns, schema=kept.schema)

    cleaned = docs.mapInArrow(run, docs.schema)
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cleaned
