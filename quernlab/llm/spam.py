"""Problem 8: pages made for search engines: keyword runs, link lists, menus, tag and product lists.

A page is a sequence of lines (long ones are cut at sentence ends, or into pieces of some words). Each
line shows one of a few symbols, by its form and by how much of it the page repeats; no symbol depends
on a language's words. A hidden Markov model with a state for prose and one for each kind of list
labels the lines, so a title between paragraphs stays prose and one word per line after another does
not. A page is flagged when more than half of its characters are in lines labelled as lists. The
model starts from stated probabilities and is trained on all pages by counting its own labels, with
the start as prior; the counts are tables of states by symbols and states by states.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernlab.llm.arrow import sliced
from quernlab.session import materialise

STATES = ("prose", "link_list", "tag_list", "menu", "keywords")
SYMBOLS = ("sentence", "long", "short", "definition", "code", "data", "link", "hashtag", "items", "product", "repeat")
PROSE = 0
#: By so much a step in prose must be likelier than any other for Viterbi to be left out; rounding is far below.
MARGIN = 1e-6
#: Training passes over all pages, and the weight of the prior in counted lines.
PASSES, PRIOR = 2, 200.0
#: Share of a page's characters outside prose above which it is flagged.
SHARE = 0.5

# The model's start. A row per state, a column per symbol.
_START = np.array([0.80, 0.05, 0.05, 0.05, 0.05])
_STAY = np.array([
    [0.97, 0.0075, 0.0075, 0.0075, 0.0075],
    [0.04, 0.93, 0.01, 0.01, 0.01],
    [0.04, 0.01, 0.93, 0.01, 0.01],
    [0.04, 0.01, 0.01, 0.93, 0.01],
    [0.04, 0.01, 0.01, 0.01, 0.93],
])
_SHOW = np.array([
    # sentence long  short  defin  code   data   link   hasht  items  produ  repeat
    [0.555, 0.100, 0.050, 0.050, 0.150, 0.050, 0.008, 0.005, 0.016, 0.008, 0.008],
    [0.004, 0.030, 0.060, 0.004, 0.004, 0.004, 0.860, 0.010, 0.010, 0.004, 0.010],
    [0.004, 0.015, 0.020, 0.004, 0.002, 0.005, 0.010, 0.350, 0.240, 0.330, 0.020],
    [0.003, 0.025, 0.480, 0.004, 0.004, 0.004, 0.020, 0.010, 0.410, 0.010, 0.030],
    [0.004, 0.030, 0.050, 0.002, 0.002, 0.002, 0.005, 0.020, 0.050, 0.005, 0.830],
])

_URL = re.compile(r"(?:https?://|www\.)\S+|\b[\w-]+(?:\.[\w-]+)+/\S*|\[[^\]\n]*\]\([^)\s]*\)|\b(?:[\w-]+\.)+(?:com|org|net|io|dev|example|test|invalid)\b", re.IGNORECASE)
_LINKED = re.compile(r"://|www\.|\]\(|\.[\w-]+[\w.-]*/|\.(?:com|org|net|io|dev|example|test|invalid)\b", re.IGNORECASE)
_WORD = re.compile(r"[぀-ヿ㐀-鿿豈-﫿]|[^\W_]+(?:['’-][^\W_]+)*")
_CJK = re.compile(r"[぀-ヿ㐀-鿿]")
_SPLIT = re.compile(r"(?<=[.!?])[\"'”’)\]]*\s+|(?<=[。！？])")
_ITEM = re.compile(r"\s*(?:[|•·»›→▸►✓★☆◆■,;，、；/]|\s[>–—-]\s)\s*")
_PRICE = re.compile(r"(?:[$€£¥₽]\s?\d|\b\d+[.,]\d\d\b(?!\d)|\b\d+\s?(?:€|EUR|USD|usd|eur|руб|元|円|\$))")
_SKU = re.compile(r"\b[A-Z]{2,}-?\d{2,}\b")
_CODE = re.compile(r"^\s*(?:>>>|\.\.\. |\$ |#include|//|/\*|@\w)|^\s*(?:def|class|import|from|return|for|while|if|elif|else|try|except|with|print|assert|public|private|static|int|let|const|var|function|package|using|select)\b.*[\(\):;{=]|[{};]\s*$|\w\(.*\)\s*[:;]?\s*$|[-+*/%]?=(?!=)\s*\S|^\s*[\[{(].*[\]})],?\s*$|=>|->|::|^\s*[}\])]+[;,]?\s*$")
_BULLET = re.compile(r"^\s*(?:[-*•+]|\d+[.)])\s+")
_DEFINITION = re.compile(r"^\s*[-*]?\s*[^:：]{2,60}[:：]\s*(?=\S)")
_END = re.compile(r"[.!?。！？:：…;]['\"”’»)\]]*\s*\Z")
#: Words of a piece that is neither a line nor a sentence.
PIECE = 30


def _pieces(text: str) -> list[tuple[str, bool]]:
    """(piece, fenced): the lines of a page, long ones cut up; fence lines are code themselves."""
    out, fenced = [], False
    for line in text.splitlines():
        if not line.strip():
            continue
        if line.lstrip().startswith(("```", "~~~")):
            fenced = not fenced
            out.append((line, True))
            continue
        if fenced or len(line) <= 160:
            parts = [line] if fenced or not _SPLIT.search(line) else [p for p in _SPLIT.split(line) if p.strip()]
        else:
            parts = [p for p in _SPLIT.split(line) if p.strip()]
        for part in parts:
            if len(part) <= 400:
                out.append((part, fenced))
                continue
            spans = [m.end() for m in re.finditer(r"\S+\s*", part)]
            at = 0
            if len(spans) <= PIECE:
                cuts = list(range(400, len(part), 400)) + [len(part)]
            else:
                cuts = spans[PIECE - 1 :: PIECE]
                if cuts[-1] != len(part):
                    cuts.append(len(part))
            for cut in cuts:
                out.append((part[at:cut], fenced))
                at = cut
    return out


def _symbol(piece: str, words: list[str], repeated: float, bigrams: float) -> str:
    bare = piece.strip()
    # Each pattern is tried only where a character that it needs is there.
    linked = sum(m.end() - m.start() for m in _URL.finditer(bare)) if _LINKED.search(bare) else 0
    if linked >= 0.5 * len(bare):
        return "link"
    tokens = bare.split() if "#" in bare else ()
    if len(tokens) >= 2 and sum(t[0] == "#" and len(t) > 1 and t[1].isalpha() for t in tokens) >= 0.6 * len(tokens):
        return "hashtag"
    n = len(words)
    letters, digits = sum(map(str.isalpha, bare)), sum(map(str.isdigit, bare))
    if not n or (digits >= 0.5 * (digits + letters) and not _PRICE.search(bare)):
        return "data"
    cjk = 0 if bare.isascii() else len(_CJK.findall(bare))
    size = n if cjk < 0.5 * n else n / 2
    if size >= 9 and _END.search(bare) and len(set(words)) >= 0.8 * n:
        return "sentence"  # however often the page has it
    if n >= 4 and repeated >= 0.75 and bigrams >= 0.3:
        return "repeat"
    if n >= 12 and repeated >= 0.6 and len(set(words)) <= 0.5 * n:
        return "repeat"
    ended = bool(_END.search(bare))
    short_form = n <= 12 and not ended
    if short_form and n >= 2 and digits and (_PRICE.search(bare) or _SKU.search(bare)) and letters >= 0.35 * len(bare) and not _CODE.search(bare):
        return "product"
    items = [i for i in _ITEM.split(_DEFINITION.sub("", bare)) if i.strip()] if n >= 5 else ()
    if len(items) >= 5:
        sizes = [len(_WORD.findall(i)) for i in items]
        if sum(s <= 4 for s in sizes) >= 0.85 * len(items) and sum(sizes) <= 3.2 * len(items) and letters >= 0.5 * len(bare):
            return "items"
    if _CODE.search(piece) and not (ended and n >= 8 and bare[0].isupper()):
        return "code"
    if digits >= 0.5 * (digits + letters):
        return "data"
    if _BULLET.match(piece) and size >= 4:
        return "sentence"
    if ended and size >= 5:
        return "sentence"
    if _DEFINITION.match(bare) and size >= 4:
        return "definition"
    if ended and size >= 2:
        return "long" if size >= 4 else "short"
    return "short" if size <= 3 else "long"


def read_page(text: str) -> tuple[list[int], list[int]]:
    """The symbols of a page's lines, and their lengths in characters."""
    pieces = _pieces(text)
    words = [[w.lower() for w in _WORD.findall(p)] for p, _ in pieces]
    count: Counter[str] = Counter()
    pairs: Counter[tuple[str, str]] = Counter()
    total = 0
    for own in words:
        total += len(own)
        count.update(own)
        pairs.update(zip(own, own[1:]))
    # A word is repeated when the page uses it again and again; a pair, when it recurs.
    often = max(3, 0.015 * total)
    twice = max(3, 0.008 * total)
    symbols, lengths = [], []
    for (piece, fenced), own in zip(pieces, words):
        if fenced:
            symbol = "code"
        else:
            repeated = sum(count[w] >= often for w in own) / len(own) if own and total >= 20 else 0.0
            recurring = sum(pairs[t] >= twice for t in zip(own, own[1:])) / (len(own) - 1) if len(own) > 1 else 0.0
            symbol = _symbol(piece, own, repeated, recurring)
        symbols.append(SYMBOLS.index(symbol))
        lengths.append(len(piece.strip()))
    return symbols, lengths


class Model:
    """Log probabilities of the hidden Markov model."""

    def __init__(self, shows: np.ndarray | None = None, moves: np.ndarray | None = None):
        show = PRIOR * _SHOW + (0 if shows is None else shows)
        stay = PRIOR * _STAY + (0 if moves is None else moves)
        self.start = np.log(_START)
        self.show = np.log(show / show.sum(1, keepdims=True))
        self.stay = np.log(stay / stay.sum(1, keepdims=True))
        self.plain = self._plain()

    def _plain(self) -> frozenset[int]:
        """The symbols that are likeliest in prose whatever came before; a page of them alone is prose throughout."""
        enter = self.stay.max(0)
        if self.stay[PROSE, PROSE] < enter[PROSE]:
            return frozenset()
        lists = [k for k in range(len(STATES)) if k != PROSE]
        within = self.stay[PROSE, PROSE] + self.show[PROSE] - (enter[lists, None] + self.show[lists]).max(0)
        first = self.start[PROSE] + self.show[PROSE] - (self.start[lists, None] + self.show[lists]).max(0)
        return frozenset(np.flatnonzero(np.minimum(within, first) > MARGIN).tolist())

    def label(self, symbols: list[int]) -> list[int]:
        """The likeliest states of a page's lines (Viterbi)."""
        if not symbols:
            return []
        if self.plain.issuperset(symbols):
            return [PROSE] * len(symbols)  # what Viterbi gives too
        best, back = self.start + self.show[:, symbols[0]], []
        for symbol in symbols[1:]:
            reach = best[:, None] + self.stay
            back.append(reach.argmax(0))
            best = reach.max(0) + self.show[:, symbol]
        states = [int(best.argmax())]
        for arrow in reversed(back):
            states.append(int(arrow[states[-1]]))
        return states[::-1]


def _read(batches):
    for batch in sliced(batches):
        pages = [read_page(t) if t and any(c.isalnum() for c in t) else ([], []) for t in batch.column("text").to_pylist()]
        lists = pa.list_(pa.int32())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([s for s, _ in pages], lists), pa.array([n for _, n in pages], lists)], names=["doc_id", "symbols", "lengths"]
        )


def read_pages(documents: DataFrame) -> DataFrame:
    """(doc_id, symbols, lengths): every page read once; null and blank texts, and those without letters and digits, have no lines."""
    return materialise(documents.select("doc_id", "text").mapInArrow(_read, "doc_id long, symbols array<int>, lengths array<int>"))


def _train(model: Model):
    def run(batches):
        shows, moves = np.zeros_like(_SHOW), np.zeros_like(_STAY)
        for batch in sliced(batches):
            for symbols in batch.column("symbols").to_pylist():
                if symbols:
                    states = model.label(symbols)
                    np.add.at(shows, (states, symbols), 1)
                    np.add.at(moves, (states[:-1], states[1:]), 1)
        flat = np.concatenate([shows.ravel(), moves.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], names=["cell", "n"])

    return run


def train(pages: DataFrame, passes: int = PASSES) -> Model:
    """The model after ``passes`` rounds of labelling all pages and counting; 80 numbers come back from each."""
    model = Model()
    for _ in range(passes):
        cells = pages.select("symbols").mapInArrow(_train(model), "cell long, n double").groupBy("cell").agg(F.sum("n").alias("n")).collect()
        flat = np.zeros(_SHOW.size + _STAY.size)
        for row in cells:
            flat[row["cell"]] = row["n"]
        shows, moves = flat[: _SHOW.size].reshape(_SHOW.shape), flat[_SHOW.size :].reshape(_STAY.shape)
        # Each state's counts are scaled to a fixed weight beside the prior, so a table's size does not change what the model is.
        scale = lambda x: 4 * PRIOR * x / np.maximum(x.sum(1, keepdims=True), 4 * PRIOR)
        model = Model(scale(shows), scale(moves))
    return model


def _share(model: Model):
    def run(batches):
        for batch in sliced(batches):
            pages = zip(batch.column("symbols").to_pylist(), batch.column("lengths").to_pylist())
            shares = [sum(n for n, s in zip(lengths, model.label(symbols)) if s != PROSE) / sum(lengths) if symbols else None for symbols, lengths in pages]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(shares, pa.float64())], names=["doc_id", "nonprose_share"])

    return run


def nonprose_shares(documents: DataFrame) -> DataFrame:
    """(doc_id, nonprose_share) of every row; null for texts without lines. Repeated rows are rows of their own."""
    pages = read_pages(documents)
    return pages.mapInArrow(_share(train(pages)), "doc_id long, nonprose_share double")


def spam_found(documents: DataFrame) -> DataFrame:
    return nonprose_shares(documents).where((F.col("nonprose_share") > SHARE) & F.col("doc_id").isNotNull()).select("doc_id").distinct()


def spam_report(documents: DataFrame) -> DataFrame:
    """(source, n_docs, n_spam, spam_share) per source; a null source is a source of its own."""
    shares = nonprose_shares(documents).groupBy("doc_id").agg(F.max("nonprose_share").alias("share"))
    return (
        documents.select("doc_id", "source").join(shares, "doc_id")
        .groupBy("source").agg(F.countDistinct("doc_id").alias("n_docs"), F.countDistinct(F.when(F.col("share") > SHARE, F.col("doc_id"))).alias("n_spam"))
        .withColumn("spam_share", F.col("n_spam") / F.col("n_docs"))
    )
