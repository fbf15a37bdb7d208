"""Quality rules as a short-circuit cascade whose order follows measured rejection per cost.

Every rule is a predicate over counts of a whole text, and a count is taken when the first rule asks for it. ``plan_cascade`` runs the rules over a
bounded random sample: it measures what each costs and how much it rejects, takes the one with the most rejection per cost, and goes on with the
texts and counts that this one leaves. ``survivors`` applies the rules in that order to every text, a batch at a time, and looks at no text after its
first rejection. The verdict is the conjunction of all rules, so the order changes the cost, never the result.

``quality_filter`` puts all rules into the cascade, the base rules among them. ``judge`` has to give the base counts of every text, so there the base
rules come first and the others follow in the cascade's order.

Defined results: a null text has no words and fails the base rules, as an empty text does; repeated rows get
the same verdict each; rows keep all their other columns whatever their names.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col

#: About so many rows, drawn at random over the whole table, are what the order is measured on; longer ones are left out: some 32 MB at most go to the driver.
SAMPLE_ROWS = 512
SAMPLE_BYTES = 1 << 16
#: Texts whose words are held at once; it bounds memory only.
BLOCK = 250
SPACE = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SCHEMA = "struct<n_words:long,word_chars:long,n_symbols:long,n_dup_lines:long,n_repeat_words:long,base_failed:boolean,kept:boolean,rejected_by:string>"


#: Odd multipliers of the hash of a window.
_MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB))


def _equal_windows(ids: np.ndarray, texts: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A number for each window of five ids that starts there, equal for equal windows of one text and for no others."""
    word = ids.astype(np.uint64)
    mixed = texts[starts].astype(np.uint64) * _MIX[5]
    for k in range(5):
        mixed += word[starts + k] * _MIX[k]
        mixed ^= mixed >> np.uint64(29)
    number = pd.factorize(mixed)[0]
    first = np.empty(int(number.max()) + 1, np.int64)
    first[number[::-1]] = np.arange(len(number))[::-1]
    other = np.flatnonzero(first[number] != np.arange(len(number)))
    mine, theirs = starts[other], starts[first[number[other]]]
    if (texts[mine] == texts[theirs]).all() and all((ids[mine + k] == ids[theirs + k]).all() for k in range(5)):
        return number  # no two windows share a hash by chance
    number = texts[starts]
    for k in range(5):
        number = pd.factorize(number * (int(ids.max()) + 1) + ids[starts + k])[0].astype(np.int64)
    return number


def repeated_words(words: list[list[bytes]]) -> list[int]:
    """For each text, how many words lie in 5-word windows that its text holds twice or more (the first included); exact: hashes are verified."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    total = int(sizes.sum())
    covered = np.zeros(total + 1, np.int64)
    if total >= 5:
        flat = pa.array([w for ws in words for w in ws], pa.binary()).dictionary_encode()
        ids = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        texts = np.repeat(np.arange(len(words)), sizes)
        starts = np.flatnonzero(texts[:-4] == texts[4:])
        if len(starts):
            number = _equal_windows(ids, texts, starts)
            many = starts[np.bincount(number)[number] >= 2]
            np.add.at(covered, many, 1)
            np.add.at(covered, many + 5, -1)
    ends = np.cumsum(sizes)
    marks = np.concatenate(([0], np.cumsum(np.cumsum(covered[:total]) > 0)))
    return (marks[ends] - marks[ends - sizes]).tolist()


class Page:
    """What the rules see of one text; each count is taken once, when it is first asked for."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def raw(self) -> bytes:
        return self.text.encode("utf-8", "surrogatepass")

    def holds(self, ascii: str) -> int:
        """How many of its characters are among these ASCII ones."""
        return len(self.raw) - len(self.raw.translate(None, ascii.encode()))

    @cached_property
    def words(self) -> list[bytes]:
        return self.raw.split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - self.holds(SPACE)

    @cached_property
    def n_symbols(self) -> int:
        return self.holds(SYMBOLS)

    @cached_property
    def n_dup_lines(self) -> int:
        lines = [x for x in self.text.split("\n") if x and x.strip(SPACE)]
        return len(lines) - len(set(lines))

    @cached_property
    def n_repeat_words(self) -> int:
        return repeated_words([self.words])[0]

    def copy(self) -> Page:
        out = Page(self.text)
        out.__dict__.update(self.__dict__)
        return out


def count_repeats(pages: list[Page]) -> None:
    """n_repeat_words of many pages at once, which is faster than one by one."""
    todo = [p for p in pages if "n_repeat_words" not in p.__dict__]
    for p, n in zip(todo, repeated_words([p.words for p in todo])):
        p.__dict__["n_repeat_words"] = n


@dataclass(frozen=True)
class Rule:
    """A named rejection; it must depend on the page alone. prepare takes counts for all pages of a batch at once."""

    name: str
    rejects: Callable[[Page], bool]
    prepare: Callable[[list[Page]], None] | None = None

    def rejected(self, pages: list[Page]) -> list[bool]:
        if self.prepare:
            self.prepare(pages)
        return list(map(self.rejects, pages))


#: Characters that Python calls upper case and that are no letters of the category Lu: Roman numerals, circled and squared letters.
_NO_LETTER = re.compile("[\u2160-\u216f\u24b6-\u24cf\U0001f130-\U0001f149\U0001f150-\U0001f169\U0001f170-\U0001f189]")


_NO_ASCII = re.compile("[^\x00-\x7f]")


def _shouting(p: Page) -> bool:
    upper = p.holds("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    if len(p.raw) != len(p.text):
        upper += sum(map(str.isupper, _NO_ASCII.findall(p.text)))
        if 2 * upper > p.word_chars:
            upper -= len(_NO_LETTER.findall(p.text))
    return 2 * upper > p.word_chars


def _stuttering(p: Page) -> bool:
    return 10 * sum(map(bytes.__eq__, p.words, p.words[1:])) > 3 * p.n_words


BASE_RULES = (
    Rule("few_words", lambda p: p.n_words < 10),
    Rule("repeated_windows", lambda p: 100 * p.n_repeat_words > 20 * p.n_words, count_repeats),
)
RULES = (
    Rule("symbols", lambda p: 10 * p.n_symbols > p.n_words),
    Rule("exclamations", lambda p: 4 * p.text.count("!") > p.n_words),
    Rule("word_length", lambda p: not 2 * p.n_words <= p.word_chars <= 25 * p.n_words),
    Rule("repeated_lines", lambda p: p.n_dup_lines >= 3 and 2 * p.n_dup_lines > p.text.count("\n") + 1),
    Rule("digits", lambda p: p.holds("0123456789") * 2 > p.word_chars),
    Rule("shouting", _shouting),
    Rule("stuttering", _stuttering),
)


def counts(texts: list[str | None]) -> list[Page]:
    """Pages of whole texts, with their repeated words counted."""
    pages = list(map(Page, texts))
    count_repeats(pages)
    return pages


def base_failed(p: Page) -> bool:
    return any(r.rejects(p) for r in BASE_RULES)


def survivors(pages: list[Page], cascade: list[Rule]) -> list[str | None]:
    """For each page the first rule that rejects it, or None; no rule sees a page that one before rejected."""
    why: list[str | None] = [None] * len(pages)
    alive = list(range(len(pages)))
    for rule in cascade:
        verdicts = rule.rejected([pages[i] for i in alive])
        for i, rejected in zip(alive, verdicts):
            if rejected:
                why[i] = rule.name
        alive = [i for i, rejected in zip(alive, verdicts) if not rejected]
    return why


@dataclass(frozen=True)
class Estimate:
    name: str
    seconds: float
    rejected: float

    @property
    def worth(self) -> float:
        return self.rejected / max(self.seconds, 1e-12)


def plan_cascade(df: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS, first: tuple[Rule, ...] = BASE_RULES) -> tuple[list[Rule], list[Estimate]]:
    """rules by rejection per cost, most worthwhile first, each measured on those rows of a random sample that the rules before it and those of first leave."""
    text = col(text_col).cast("string")
    share = sample_rows / max(1, df.count())
    sample = df.select(text.alias("t")).sample(min(1.0, share), 17).filter(F.coalesce(F.octet_length("t"), F.lit(0)) <= SAMPLE_BYTES).collect()  # sample_rows rows on average
    return order_rules([t for (t,) in sample], rules, first)


def order_rules(texts: list[str | None], rules: tuple[Rule, ...] = RULES, first: tuple[Rule, ...] = BASE_RULES) -> tuple[list[Rule], list[Estimate]]:
    pages = list(map(Page, texts))
    pages = [p for p, why in zip(pages, survivors(pages, list(first))) if why is None]
    left, order, found = list(rules), [], []
    while left:
        estimates = {}
        for rule in left:
            best, verdicts = float("inf"), []
            for _ in range(2):  # the quicker of two, as the first may meet a cold cache
                fresh = [p.copy() for p in pages]
                began = time.thread_time()
                verdicts = rule.rejected(fresh)
                best = min(best, time.thread_time() - began)
            estimates[rule.name] = Estimate(rule.name, best / max(1, len(pages)), sum(verdicts) / max(1, len(pages)))
        rule = min(left, key=lambda r: (-estimates[r.name].worth, estimates[r.name].seconds, r.name))
        order.append(rule)
        found.append(estimates[rule.name])
        left.remove(rule)
        pages = [p for p, rejected in zip(pages, rule.rejected(pages)) if not rejected]
    return order, found


def judge(text: Column, cascade: list[Rule]) -> Column:
    """A struct of the base counts, base_failed, kept and rejected_by (null if kept) for each whole text."""

    @F.arrow_udf(SCHEMA)
    def verdict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = []
            texts = batch.to_pylist()
            for at in range(0, len(texts), BLOCK):
                pages = counts(texts[at : at + BLOCK])
                bad = list(map(base_failed, pages))
                rest = iter(survivors([p for p, b in zip(pages, bad) if not b], cascade))
                for p, b in zip(pages, bad):
                    why = "base" if b else next(rest)
                    rows.append((p.n_words, p.word_chars, p.n_symbols, p.n_dup_lines, p.n_repeat_words, b, why is None, why))
            kinds = [*[pa.int64()] * 5, pa.bool_(), pa.bool_(), pa.string()]
            columns = list(zip(*rows)) or [()] * 8
            yield pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[*COUNTS, "base_failed", "kept", "rejected_by"])

    return verdict(text)


def passes(text: Column, cascade: list[Rule]) -> Column:
    """Whether each whole text passes every rule of the cascade; what no rule asks for is never counted."""

    @F.arrow_udf("boolean")
    def kept(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            texts = batch.to_pylist()
            out: list[bool] = []
            for at in range(0, len(texts), BLOCK):
                out += [why is None for why in survivors(list(map(Page, texts[at : at + BLOCK])), cascade)]
            yield pa.array(out, pa.bool_())

    return kept(text)


def quality_filter(df: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = (*BASE_RULES, *RULES), sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of df whose text passes every rule, with the columns of df."""
    cascade, _ = plan_cascade(df, text_col, rules, sample_rows, ())
    return df.filter(passes(col(text_col).cast("string"), cascade))
