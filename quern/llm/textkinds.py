"""Per-document text statistics, and line kinds from a hidden Markov model.

Every line gives a vector of statistics; a hidden Markov model with the
states prose, list, table and junk labels the lines of a document (most
likely path, worked out for all documents of a batch at once), and the
labels are summed by their share of the characters.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("prose", "list", "table", "junk")
#: Steps of a score of letter pairs by which the median over all texts is found.
STEPS = 2_048
#: Letter pairs that a text weighs at most, all of its pairs in proportion, so that no single text is the yardstick; in whole parts, for sums that no order changes.
WEIGHT, PARTS = 4_000, 1 << 20
#: log P(next line's kind | kind): runs of one kind are likely, table rows most of all.
STAY = {"prose": 0.80, "list": 0.86, "table": 0.90, "junk": 0.86}

_WORD = re.compile(r"[^\W_]+")
_MARK = re.compile(r"^\s*(?:[-*+•–—▪◦‣·]|\[[ xX]?\]|\(?(?:\d{1,4}|[a-zA-Z])[.)]|#\d+)\s+(?=\S)")
_GAPS = re.compile(r"\S(?: {2,}|\t)(?=\S)|\S {3,}$")
_WIDE = re.compile(r"\S {4,}\S")
_COMMA = re.compile(r"[^\s,],(?=[^\s])|,,")
_ENDS = re.compile(r"""[.!?…。:;][)\]}"'”’»]*(?:\s*[:;]-?[)(DP])?$""")
_SCRAP = re.compile(r"^(?:\W+|\W*(?:nan|null|undefined|none|object|0x[0-9a-f]+|nbsp|%%\w+%%|lorem)\b(?:\W+|nan|null|undefined|none|object|nbsp|0x[0-9a-f]+)*)$", re.I)
_CODE = re.compile(r"[{};]\s*$|^\s*[.#][\w-]+\s*\{|^\s*</?\w+[^>]*>\s*$|:\s*[^\s;]+;")
_RULE = re.compile(r"^\s*[.#@]?[\w-]+\s*\{[^{}]*\}?\s*$")
_DIRT = re.compile(r"[A-Za-z][#~0-9]+(?=[A-Za-z])|[#~][A-Za-z]|[A-Za-z][#~]|\s[.,;#~](?=\s)|[A-Za-z]\|(?=[a-z])|\s\|[a-z]")
_FOLD = str.maketrans("àáâãäåçèéêëìíîïñòóôõöùúûüýÿœæß", "aaaaaaceeeeiiiinooooouuuuyyoas")


_CODES = np.array([ord(c) - 96 if "a" <= c <= "z" else 27 if ord(c) > 127 else 0 for c in (chr(i).translate(_FOLD) for i in range(512))])


def _plain(text: str | None) -> str:
    return (text or "").replace("\ufeff", "").replace("\r\n", "\n").replace("\r", "\n")


class Letters:
    """Mean log-probability of letter pairs inside words, from their counts in all texts, and the median text's (`usual`)."""

    def __init__(self, counts: np.ndarray) -> None:
        counts = counts + 5.0  # weighs little beside many texts, and keeps a handful of texts from being a yardstick
        self.logp = np.log(counts / counts.sum(axis=1, keepdims=True))
        self.usual = -3.0

    @staticmethod
    def codes(text: str) -> np.ndarray:
        """0 for what is no letter, 1 to 26 for a to z, 27 for other letters."""
        out = _CODES[np.minimum(np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32), 511)]
        return out[(out > 0) | (np.concatenate([[1], out[:-1]]) > 0)]

    @staticmethod
    def pairs(text: str) -> np.ndarray:
        """Counts of all letter pairs of the text in PARTS, brought to a sum of WEIGHT where they are more."""
        codes = Letters.codes(text)
        counts = np.bincount(codes[:-1] * 28 + codes[1:], minlength=784)
        return np.rint(counts * (PARTS * min(1.0, WEIGHT / max(1, len(codes) - 1)))).astype(np.int64)

    def score(self, text: str) -> float:
        codes = self.codes(text)
        return float(self.logp[codes[:-1], codes[1:]].mean()) if len(codes) > 3 else self.usual


def _pair_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(784, np.int64)
    for batch in batches:
        for text in batch.column("t").to_pylist():
            total += Letters.pairs(_plain(text))
    yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(total)), pa.array(total[total > 0])], ["k", "n"])


def _score_counts(batches: Iterator[pa.RecordBatch], letters: Letters) -> Iterator[pa.RecordBatch]:
    steps: Counter[int] = Counter()
    for batch in batches:
        steps.update(round(letters.score(x) * STEPS) for x in map(_plain, batch.column("t").to_pylist()) if len(x) > 40)
    yield pa.RecordBatch.from_arrays([pa.array(list(steps), pa.int64()), pa.array(list(steps.values()), pa.int64())], ["k", "n"])


def letter_model(data: DataFrame) -> Letters:
    """The letter model of all whole texts t; `usual` to 1 / STEPS. At most 784 sums and a histogram reach the driver."""
    data = data.where("t is not null").select("t")
    summed = lambda f: data.mapInArrow(f, "k bigint, n bigint").groupBy("k").agg(F.sum("n").alias("n")).orderBy("k").collect()
    counts = np.zeros(784)
    for r in summed(_pair_counts):
        counts[r["k"]] = r["n"] / PARTS
    letters = Letters(counts.reshape(28, 28))
    rows = summed(lambda it: _score_counts(it, letters))
    if rows:
        until = np.cumsum([r["n"] for r in rows])
        middle = [rows[int(np.searchsorted(until, i, side="right"))]["k"] for i in ((until[-1] - 1) // 2, until[-1] // 2)]
        letters.usual = sum(middle) / 2 / STEPS
    return letters


def _dirty(line: str, n: int) -> bool:
    """More than 0.3 n places with marks or digits inside the words; each holds one of the counted characters."""
    return sum(map(line.count, "#~|.,;0123456789")) > 0.3 * n and len(_DIRT.findall(line)) > 0.3 * n


def fields_of(line: str) -> int:
    """Separators between fields of a row: bars, tabs, wide gaps, semicolons or commas without a space behind."""
    bars, tabs, semis = line.count("|"), line.count("\t"), line.count(";")
    commas = len(_COMMA.findall(line)) if line.count(",") > line.count(", ") else 0  # each one before a space: none counts
    gaps = len(_GAPS.findall(line.strip())) if "  " in line or tabs else 0
    if "    " in line and _WIDE.search(line):
        gaps = max(gaps, 2)  # columns of fixed width, some of them empty
    return max(bars, tabs, gaps, semis if "; " not in line else 0, commas)


def line_scores(line: str, words: list[str], alpha: int, solid: int, frequent: int, ends: bool, strange: bool, again: bool = False) -> tuple[float, float, float, float]:
    """log-likelihood of the line in each kind, up to a shared constant; `alpha` and `solid` are its letters and digits and its characters that are no white space, `strange` and `again` what is known of its whole text: odd letter pairs, one scrap over and over."""
    n = len(words)
    symbols = 1 - alpha / solid
    share = frequent / n if n else 0.0
    mark = bool(_MARK.match(line))
    fields = fields_of(line)
    sizes = list(map(len, words))
    longest = max(sizes, default=0)
    prose = listed = table = junk = 0.0
    if n == 0 or alpha == 0:
        if "|" in line and not again and re.fullmatch(r"[\s|:+=-]+", line):
            return -6.0, -4.0, 0.0, -3.0
        return -6.0, -4.0, -5.0, 0.0
    prose += 4.0 * min(share / 0.25, 1.2) - 3.0 + (1.0 if n >= 7 else -0.6 * (7 - n) / 2) + (0.8 if ends else -0.4)
    listed += (3.0 if mark else 0.6) + (0.8 if n <= 7 else -0.35 * (n - 7)) - 3.0 * max(0.0, share - 0.35) - (1.0 if ends and not mark else 0.0) + (0.6 if n <= 7 and share < 0.34 else 0.0)
    table += (1.6 + 0.6 * min(fields, 5) if fields >= 2 else -2.5) - 4.0 * share - (1.0 if mark and fields < 3 else 0.0)
    if fields >= 2 and share < 0.15:
        table += 1.0
        prose -= 1.0
        listed -= 1.5
    single = sizes.count(1) / n
    junk += 12.0 if again else -1.8
    if symbols > 0.45:
        junk += 6.0 * symbols + (1.0 if fields < 2 else -2.0)
        prose -= 3.0
        listed -= 2.0
    if strange and share < 0.2:
        junk += 6.0
        prose -= 3.0
        listed -= 3.0
        table -= 1.5
    if longest > 30 and share < 0.1 and not line.lstrip().startswith("http"):
        junk += 4.5
        listed -= 2.0
    if single > 0.6 and n >= 8:
        junk += 5.0
        prose -= 2.0
        listed -= 2.0
    if _SCRAP.match(line.strip()):
        junk += 5.0
        listed -= 2.0
    if n >= 6 and _dirty(line, n):  # marks and digits inside the words
        junk += 8.0
        prose -= 2.0
        table -= 3.0
    if "{" in line and _RULE.match(line):
        junk += 6.0
        table -= 4.0
    if share < 0.15 and _CODE.search(line):
        junk += 3.5
        listed -= 1.0
        table -= 2.0
    return prose, listed, table, junk


def _kinds(scores: np.ndarray, rows: np.ndarray, weights: np.ndarray, documents: int) -> np.ndarray:
    """Share of each kind's weight per document along its most likely path; rows: the document of each line, in order."""
    size = np.bincount(rows, minlength=documents)
    begin = np.cumsum(size) - size
    k = len(KINDS)
    move = np.empty((k, k))
    for i, kind in enumerate(KINDS):
        move[i] = np.log((1 - STAY[kind]) / (k - 1))
        move[i, i] = np.log(STAY[kind])
    back = np.zeros((len(rows), k), np.int8)
    best = np.zeros((documents, k))
    by_size = np.argsort(-size, kind="stable")
    live = by_size[size[by_size] > 0]
    best[live] = scores[begin[live]]
    for step in range(1, int(size.max(initial=0))):
        live = live[: np.searchsorted(-size[live], -step, side="left")]
        options = best[live][:, :, None] + move[None]
        at = begin[live] + step
        back[at] = options.argmax(axis=1)
        best[live] = options.max(axis=1) + scores[at]
    state = best.argmax(axis=1)
    out = np.zeros((documents, k))
    live = by_size[size[by_size] > 0]
    for step in range(int(size.max(initial=0)) - 1, -1, -1):
        now = live[: np.searchsorted(-size[live], -step, side="left")]
        at = begin[now] + step
        np.add.at(out, (now, state[now]), weights[at])
        state[now] = back[at, state[now]]
    total = out.sum(axis=1, keepdims=True)
    return np.divide(out, total, out=out, where=total > 0)


def repeats(words: list[str]) -> bool:
    """One scrap over and over: few different words and word triples."""
    if len(words) < 8:
        return len(words) >= 4 and len(set(words)) == 1
    if len(set(words)) > max(6, 0.12 * len(words)):
        return False
    return len(set(zip(words, words[1:], words[2:]))) <= 0.12 * (len(words) - 2)


def _statistics(batches: Iterator[pa.RecordBatch], common: frozenset[str], letters: Letters) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("t").to_pylist()
        rows, scores, weights, numbers = [], [], [], []
        for i, text in enumerate(texts):
            text = _plain(text)
            lines = [x for x in text.split("\n") if x.strip()]
            own = [_WORD.findall(x.lower()) for x in lines]
            alphas = [sum(map(len, w)) for w in own]
            solids = [len("".join(x.split())) for x in lines]
            hits = [sum(map(common.__contains__, w)) for w in own]
            ends = [bool(_ENDS.search(x.rstrip())) for x in lines]
            n, solid, frequent = sum(map(len, own)), sum(solids), sum(hits)
            numbers.append((n, sum(alphas) / n if n else None, 1 - sum(alphas) / solid if solid else None, sum(ends) / len(lines) if lines else None, frequent / n if n else None))
            again = repeats([w for words in own for w in words])
            strange = bool(lines) and (not n or frequent < 0.2 * n) and letters.score(text) < letters.usual - 0.55
            for one in zip(lines, own, alphas, solids, hits, ends):
                rows.append(i)
                weights.append(len(one[0].strip()))
                scores.append(line_scores(*one, strange, again))
        shares = _kinds(np.array(scores, float).reshape(-1, len(KINDS)), np.array(rows, np.int64), np.array(weights, float), len(texts))
        has = shares.sum(axis=1) > 0
        kind = [KINDS[k] if ok else None for k, ok in zip(shares.argmax(axis=1), has)]
        columns = list(zip(*numbers)) if numbers else [[]] * 5
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array(columns[0], pa.int64()), *(pa.array(c, pa.float64()) for c in columns[1:]), *(pa.array(np.where(has, shares[:, k], np.nan), pa.float64(), from_pandas=True) for k in range(4)), pa.array(kind, pa.string())],
            ["id", "words", "mean_word", "symbols", "ended_lines", "common", *KINDS, "kind"],
        )


def text_statistics(df: DataFrame, common: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: key, words, mean_word, symbols, ended_lines, common, the shares prose, list, table and junk, and kind.

    Words are runs of letters or digits; `symbols` is the share of characters
    other than letters, digits and white space among those that are no white
    space; `ended_lines` the share of non-blank lines that end in punctuation;
    `common` the share of words in the table `common` (lang, word), whatever
    the language. Null and blank texts have 0 words and null shares and kind;
    repeated rows and null keys are kept; other columns are ignored. `common`
    is a fixed small table and is collected; its rows are checked to be under
    10,000.
    """
    rows = [r[0] for r in common.where("word is not null").select(F.lower("word")).distinct().limit(10_001).collect()]
    if len(rows) > 10_000:
        raise ValueError("common words are meant to be a short list")
    known = frozenset(rows)
    data = df.select(F.col(key).alias("id"), F.col(text).cast("string").alias("t"))
    letters = letter_model(data)
    kind = data.schema["id"].dataType.simpleString()
    shares = ", ".join(f"`{k}` double" for k in KINDS)
    return data.mapInArrow(lambda it: _statistics(it, known, letters), f"id {kind}, words bigint, mean_word double, symbols double, ended_lines double, common double, {shares}, kind string").withColumnRenamed("id", key)
