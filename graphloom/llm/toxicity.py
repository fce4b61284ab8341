"""Abusive, hateful or sexual passages in texts of any language and spelling (problem 10).

A text is normalised (look-alike letters, digits for letters, split and masked words), cut into sentences
and these into short windows. A linear classifier over word sequences of one to three words scores every
window; a text scores as its worst window. There is no list of bad words: what speaks for badness is learned.
Training needs labels of whole texts only: positive windows of bad texts are chosen by the classifier itself
in a few rounds (multiple-instance learning), and texts whose label it contradicts firmly are left out as
misjudged. The training is regularised counterfactually: in every labelled window that names a people the
name is swapped for a neutral name, and any change of the score by the swap is penalised, so naming a group
carries no score. Names of peoples are learned from the sample too (``learn_terms``) or passed in; all of
them are one word to the classifier, so swapping one for another changes nothing by construction.

Everything runs on whole Arrow batches: normalising and splitting in Arrow's kernels, spelling once per
distinct token, sequences as 64-bit hashes, window sums by prefix sums.

The classifier is fitted on the driver on at most ``max_texts`` labelled texts, a bounded sample (by hash of
the id); scoring, rates and everything else cover all texts in full, in one pass.

Defined cases
* null and empty texts score 0 and are no case; a text judged several times takes the majority, bad on ties
* null labels and labels other than bad and ok are left out; without any bad or any ok label all scores are 0
* very long texts are scored window by window to their end
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Letters of other scripts that look like Latin ones.
LOOKALIKES = str.maketrans(
    {
        "а": "a", "е": "e", "о": "o", "с": "c", "і": "i", "р": "p", "у": "y", "х": "x", "ѕ": "s", "ј": "j", "һ": "h", "ԁ": "d", "ո": "n", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h",
        "ν": "v", "ο": "o", "α": "a", "ι": "i", "ρ": "p", "υ": "u", "κ": "k", "τ": "t", "χ": "x", "ѵ": "v", "ԛ": "q", "ԝ": "w", "ɡ": "g", "ı": "i",
        "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "К": "K", "М": "M", "О": "O", "Р": "P", "Т": "T", "Х": "X", "У": "Y", "Ѕ": "S", "Ј": "J",
    }
)
# Digits and signs written for letters.
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "€": "e", "|": "l"})
# Articles and quantifiers before, and plural verbs behind, the name of a people (en, de, fr, es).
BEFORE_PEOPLE = frozenset("the all these those les ces die diese los las estos".split())
BEHIND_PEOPLE = frozenset("are were have should do did sind waren haben sollten sont étaient ont devraient son eran han deben".split())

NAME, GROUP, MASK, NUMBER = "<name>", "<group>", "<mask>", "#"
WINDOW, STEP = 14, 7
#: characters of text worked on at a time; one longer text is worked on alone
SLICE = 4_000_000

_UNSEEN = "[\u00ad\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff]"
_OTHER_SCRIPT = "[ɐ-ʯͰ-ᶿ]"
_LETTERS_APART = r"(?:^|[^\p{L}\p{N}_.])\p{L}(?: ?[.\-_·*~] ?| )\p{L}(?: ?[.\-_·*~] ?| )\p{L}(?:[^\p{L}\p{N}_]|$)"
_SPLIT_WORD = re.compile(r"(?<![\w.])[^\W\d_](?:(?P<s> ?[.\-_·*~] ?)[^\W\d_])(?:(?P=s)[^\W\d_])+(?![\w])")
_SPACED = re.compile(r"(?<!\w)[^\W\d_](?: [^\W\d_]){3,}(?!\w)")
_NUMBER = re.compile(r"\d+(?:st|nd|rd|th|km|m)?")


def _unfold(text: str) -> str:
    """Look-alikes replaced, words written letter by letter joined."""
    text = _SPLIT_WORD.sub(lambda m: re.sub(r"[^\w]|_", "", m[0]), text.translate(LOOKALIKES))
    return _SPACED.sub(lambda m: m[0].replace(" ", ""), text)


@functools.lru_cache(maxsize=200_000)
def spelling(token: str) -> str | None:
    """The word a token stands for: small letters without accents, signs read as letters, doubled letters once."""
    w = token.strip("!|").lstrip("*")
    if not any(c.isalnum() for c in w):
        return None
    if _NUMBER.fullmatch(w):
        return NUMBER
    w = unicodedata.normalize("NFD", w.lower().replace("ß", "ss"))
    w = "".join(c for c in w if not unicodedata.combining(c))
    if not w.isalpha() and "*" not in w and any(c.isalpha() for c in w):
        w = w.translate(LEET)
    return re.sub(r"([^*])\1+", r"\1", w)


@dataclass
class Tokens:
    """Tokens of a batch of texts: the distinct ones, and for each place its token, sentence and text."""

    distinct: list[str]
    at: np.ndarray
    sentence: np.ndarray
    text_of: np.ndarray  # by sentence
    texts: int


def tokens_of(texts: pa.Array) -> Tokens:
    a = pc.utf8_normalize(pc.fill_null(texts.cast(pa.string()), ""), form="NFKC")
    a = pc.replace_substring_regex(pc.replace_substring_regex(a, _UNSEEN, ""), "-[ ]?\n[ ]?", "")
    odd = pc.or_(pc.match_substring_regex(a, _OTHER_SCRIPT), pc.match_substring_regex(a, _LETTERS_APART))
    if pc.any(odd).as_py():
        a = pc.replace_with_mask(a, odd, pa.array([_unfold(t) for t in a.filter(odd).to_pylist()], a.type))
    a = pc.replace_substring_regex(a, r"([.!?])[\"”»']?\s+", "\\1\x01")
    a = pc.replace_substring_regex(a, r"\n\s*\n", "\x01")
    a = pc.replace_substring_regex(a, r"\n(\s*(?:[-*•=]|[^\s:]{1,20}: ))", "\x01\\1")
    parts = pc.split_pattern(a, "\x01")
    text_of = np.repeat(np.arange(len(a)), np.diff(np.asarray(parts.offsets)))
    s = pc.replace_substring_regex(parts.flatten(), "[\"“”„«»]", ' " ')
    s = pc.utf8_trim_whitespace(pc.replace_substring_regex(s, r"[^\p{L}\p{N}\p{M}*@$!|€\"]+", " "))
    words = pc.split_pattern(s, " ")
    sentence = np.repeat(np.arange(len(s)), np.diff(np.asarray(words.offsets)))
    d = pc.dictionary_encode(words.flatten())
    return Tokens(d.dictionary.to_pylist(), np.asarray(d.indices).astype(np.int64), sentence, text_of, len(a))


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One 64-bit hash of two."""
    x = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b + np.uint64(0x7F4A7C15) + (a << np.uint64(6)))
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _code(word: str) -> int:
    return xxhash.xxh64_intdigest(word)


@dataclass
class Spans:
    """Words of a batch as codes, with the windows over them."""

    code: np.ndarray
    quoted: np.ndarray
    sentence: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    text: np.ndarray  # by window

    def grams(self, code: np.ndarray | None = None) -> list[np.ndarray]:
        """Hashes of the one, two and three words that end at each place; words in quotation marks count as other words."""
        code = self.code if code is None else code
        x = np.where(self.quoted, code ^ np.uint64(0xABCDEF1234567), code)
        one, two, three = _mix(x, np.ones_like(x)), np.zeros_like(x), np.zeros_like(x)
        near = self.sentence[1:] == self.sentence[:-1]
        two[1:][near] = _mix(x[:-1], x[1:])[near]
        near = near[1:] & near[:-1]
        three[2:][near] = _mix(_mix(x[:-2], x[1:-1]), x[2:])[near]
        return [one, two, three]

    def rows(self, grams: list[np.ndarray], begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, sequence) of every sequence within each window."""
        rows, values = [], []
        for k, g in enumerate(grams):
            n = np.maximum(end - begin - k, 0)
            r = np.repeat(np.arange(len(begin)), n)
            rows.append(r)
            values.append(g[np.arange(len(r)) - np.repeat(np.cumsum(n) - n, n) + (begin + k)[r]])
        return np.concatenate(rows), np.concatenate(values)


def _windows(sentence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Beginnings and ends of windows: short sentences whole, longer ones by overlapping stretches."""
    if not len(sentence):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.r_[True, sentence[1:] != sentence[:-1]])
    length = np.diff(np.r_[first, len(sentence)])
    whole = length <= WINDOW + STEP // 2
    n = np.where(whole, 1, -(-(length - STEP) // STEP))
    own = np.repeat(np.arange(len(first)), n)
    begin = first[own] + STEP * (np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n))
    last = (first + length)[own]
    return begin, np.where(whole[own], last, np.minimum(begin + WINDOW, last))


@dataclass
class Scorer:
    """What scoring needs: the vocabulary, spellings of masked words, names of peoples, weights, and the threshold."""

    known: frozenset = frozenset()
    masked: dict[tuple, str] = field(default_factory=dict)
    terms: frozenset = frozenset()
    grams: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = -9.0
    threshold: float = 0.7

    def word(self, w: str) -> str:
        if "*" in w:
            w = self.masked.get((w[:1], len(w), w[-1:]), MASK)
        if w in self.terms:
            return GROUP
        return w if w in self.known else NAME

    def spans(self, t: Tokens) -> Spans:
        mark = np.array([x == '"' for x in t.distinct], bool)
        words = [None if m else spelling(x) for x, m in zip(t.distinct, mark)]
        codes = np.array([0 if w is None else _code(self.word(w)) for w in words], np.uint64)
        real = np.array([w is not None for w in words], bool)
        is_mark = mark[t.at] if len(t.at) else np.zeros(0, bool)
        # within quotation marks: behind an odd number of marks, in sentences of more than one mark
        marks = np.bincount(t.sentence[is_mark], minlength=len(t.text_of))
        before = np.cumsum(marks) - marks
        quoted = ((np.cumsum(is_mark) - before[t.sentence]) % 2 == 1) & (marks[t.sentence] > 1)
        keep = real[t.at] if len(t.at) else np.zeros(0, bool)
        sentence = t.sentence[keep]
        begin, end = _windows(sentence)
        return Spans(codes[t.at[keep]], quoted[keep], sentence, begin, end, t.text_of[sentence[begin]])

    def scores(self, texts: pa.Array) -> np.ndarray:
        """Score of each text: the chance that its worst window is bad."""
        t = tokens_of(texts)
        s = self.spans(t)
        out = np.full(t.texts, -np.inf)
        if len(self.grams) and len(s.begin):
            z = np.full(len(s.begin), self.bias)
            for k, g in enumerate(s.grams()):
                at = np.minimum(np.searchsorted(self.grams, g), len(self.grams) - 1)
                total = np.r_[0.0, np.cumsum(np.where(self.grams[at] == g, self.weight[at], 0.0))]
                z += total[s.end] - total[np.minimum(s.begin + k, s.end)]
            np.maximum.at(out, s.text, z)
        return np.where(np.isneginf(out), 0.0, 1 / (1 + np.exp(-np.clip(out, -30, 30))))

    def score(self, text: str | None) -> float:
        return float(self.scores(pa.array([text], pa.string()))[0])


def learn_terms(t: Tokens, min_texts: int = 3) -> frozenset:
    """Names of peoples: capitalised words that stand, in several texts, behind an article and before a plural verb."""
    d = t.distinct
    before = np.array([x.lower() in BEFORE_PEOPLE for x in d])
    behind = np.array([x.lower() in BEHIND_PEOPLE for x in d])
    proper = np.array([x[:1].isupper() and x[1:].islower() and len(x) > 2 for x in d])
    small = {spelling(x) for x in d if x[:1].islower()}
    at = t.at
    hit = 1 + np.flatnonzero(before[at[:-2]] & proper[at[1:-1]] & behind[at[2:]] & (t.sentence[:-2] == t.sentence[2:])) if len(at) > 2 else np.zeros(0, int)
    texts: dict[str, set] = {}
    for k in hit:
        texts.setdefault(spelling(d[at[k]]), set()).add(t.text_of[t.sentence[k]])
    found = {w for w, x in texts.items() if w and w not in small and len(x) >= min_texts}
    return frozenset(found | {w[:-1] for w in found if w.endswith("s")})


@dataclass
class Sample:
    """Labelled texts as words and windows under a vocabulary."""

    scorer: Scorer
    spans: Spans
    bad: np.ndarray


def prepare(texts: list[str], bad: list[bool], terms=None, min_count: int = 2) -> Sample:
    """Vocabulary, masked spellings and names of peoples of the labelled texts.

    Words that are hardly ever written small are names; all names are one word to the classifier.
    """
    label = np.array(bad, bool)
    t = tokens_of(pa.array(texts, pa.string()))
    s = Scorer(terms=learn_terms(t) if terms is None else frozenset(spelling(x) for x in terms))
    words = [spelling(x) for x in t.distinct]
    index: dict[str, int] = {}
    of = np.array([index.setdefault(w, len(index)) if w else -1 for w in words], np.int64)
    here = of[t.at] if len(t.at) else np.zeros(0, np.int64)
    text = t.text_of[t.sentence]
    low = np.array([x[:1].islower() or x[:1].isdigit() for x in t.distinct], bool)

    def in_texts(mask: np.ndarray) -> np.ndarray:
        return np.unique(text[mask] * len(index) + here[mask])

    every = in_texts(here >= 0)
    total = np.bincount(every % max(len(index), 1), minlength=len(index))
    in_bad = np.bincount((every % max(len(index), 1))[label[every // max(len(index), 1)]], minlength=len(index))
    written_small = np.bincount(in_texts((here >= 0) & low[t.at]) % max(len(index), 1), minlength=len(index)) if len(here) else total
    s.known = frozenset(w for w, k in index.items() if total[k] >= min_count and "*" not in w and written_small[k] >= 0.2 * total[k])
    share = label.mean() if len(label) else 0.0
    best: dict[tuple, tuple] = {}
    for w in s.known:
        if len(w) > 2:
            k = index[w]
            rank = ((in_bad[k] + share) / (total[k] + 1) * min(total[k], 20), w)
            key = (w[0], len(w), w[-1])
            best[key] = max(best.get(key, rank), rank)
    s.masked = {k: w for k, (_, w) in best.items()}
    return Sample(s, s.spans(t), label)


class _Matrix:
    """Windows as rows of a count matrix, held as flat index arrays."""

    def __init__(self, row: np.ndarray, column: np.ndarray, rows: int, columns: int):
        self.row, self.column, self.rows, self.columns = row, column, rows, columns

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.column], minlength=self.rows)

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, weights=g[self.row], minlength=self.columns)


def _descend(x: _Matrix, pos: np.ndarray, neg: np.ndarray, here: _Matrix, there: _Matrix, l2: float, counter: float, steps: int, only_against: np.ndarray, w: np.ndarray, b: float):
    """Logistic loss with weights ``pos`` and ``neg`` of each row + l2 |w|^2 + counter (w.x - w.x')^2 over swapped windows, by Adam on all rows."""
    w = w.copy()
    m, v, mb, vb = np.zeros(len(w)), np.zeros(len(w)), 0.0, 0.0
    total = (pos + neg).sum()
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x.dot(w) + b, -30, 30)))
        g = ((pos + neg) * p - pos) / total
        grad, gb = x.back(g) + l2 * w, g.sum()
        if counter and here.rows:
            d = 2 * counter * (here.dot(w) - there.dot(w)) / here.rows
            grad += here.back(d) - there.back(d)
        rate = 0.08 * (1 - 0.8 * t / steps)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb**2
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        w[only_against] = np.minimum(w[only_against], 0.0)
        b -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-9)
    return w, b


def fit(sample: Sample, rounds: int = 4, steps: int = 120, l2: float = 3e-6, counter: float = 0.5, share: float = 0.7, deviations: float = 1.6, min_count: int = 2) -> Scorer:
    """Scorer from the labelled sample.

    A sequence can speak for badness if a ``share`` of the judged texts with it are bad, and more of them than
    chance gives (``deviations``); any other can only speak against it.
    """
    s, spans, bad = sample.scorer, sample.spans, sample.bad
    if not bad.any() or bad.all() or not len(spans.begin):
        return s
    label = bad[spans.text]
    row, value = spans.rows(spans.grams(), spans.begin, spans.end)
    grams, column = np.unique(value, return_inverse=True)
    pairs = np.unique(column * len(bad) + spans.text[row])
    in_bad = np.bincount((pairs // len(bad))[bad[pairs % len(bad)]], minlength=len(grams))
    n = np.bincount(pairs // len(bad), minlength=len(grams))
    # sequences of single texts would only be learned by heart
    used = n >= min_count
    base = bad.mean()
    speaks = ((in_bad + 0.5) / (n + 1) >= share) & (in_bad - n * base >= deviations * np.sqrt(n * base * (1 - base)))
    grams, speaks, place = grams[used], speaks[used], np.cumsum(used) - 1
    held = used[column]
    row, column = row[held], place[column[held]]

    # equal windows are one row
    same = np.bincount(row, weights=np.random.default_rng(0).random(len(grams))[column], minlength=len(label))
    _, first, own = np.unique(same, return_index=True, return_inverse=True)
    place = np.full(len(label), -1)
    place[first] = np.arange(len(first))
    kept = place[row] >= 0
    x = _Matrix(place[row[kept]], column[kept], len(first), len(grams))

    names = np.uint64(_code(GROUP))
    met = np.r_[0, np.cumsum(spans.code == names)]
    with_group = met[spans.end] > met[spans.begin]

    def matrix(code: np.ndarray | None) -> _Matrix:
        r, g = spans.rows(spans.grams(code), spans.begin[with_group], spans.end[with_group])
        k = np.minimum(np.searchsorted(grams, g), len(grams) - 1)
        ok = grams[k] == g
        return _Matrix(r[ok], k[ok], int(with_group.sum()), len(grams))

    here, there = matrix(None), matrix(np.where(spans.code == names, np.uint64(_code(NAME)), spans.code))

    # First guess: in a bad text, the windows with some wording that speaks for badness.
    guess = label & (x.dot(speaks.astype(float))[own] >= 3)
    positive, weight = guess, np.where(label & ~guess, 0.0, 1.0)
    w, b = np.zeros(len(grams)), -4.0
    for _ in range(rounds):
        raised = np.where(positive, max(1.0, 0.2 * weight[~positive].sum() / max(weight[positive].sum(), 1.0)), 1.0) * weight
        pos = np.bincount(own, weights=raised * positive, minlength=x.rows)
        neg = np.bincount(own, weights=raised * ~positive, minlength=x.rows)
        w, b = _descend(x, pos, neg, here, there, l2, counter, steps, ~speaks, w, b)
        z = (x.dot(w) + b)[own]
        # of a bad text the windows that are like other bad ones; the rest is as good as any other text's
        positive = label & ((z > 1.0) | (guess & (z > -1.0)))
        weight = np.where(label & ~positive, np.where(z < -2.0, 0.5, 0.0), 1.0)
        # a good text with a window like nothing but bad ones was misjudged
        weight = np.where(~label & (z > 3.0), 0.0, weight)
    s.grams, s.weight, s.bias = grams, w, float(b)
    return s


def labelled(docs: DataFrame, labels: DataFrame, max_texts: int = 10_000) -> tuple[list[str], list[bool]]:
    """Texts and majority labels of at most ``max_texts`` judged documents."""
    votes = labels.where(F.col("label").isin("bad", "ok") & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.sum(F.when(F.col("label") == "bad", 1).otherwise(-1)).alias("v"))
    votes = votes.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_texts)
    got = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(votes), "doc_id").orderBy("doc_id").toPandas()
    return list(got["text"]), [v >= 0 for v in got["v"]]


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Stretches of a batch of at most ``SLICE`` characters, or of one longer text."""
    size = np.cumsum(np.asarray(pc.fill_null(pc.utf8_length(texts), 0)))
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + SLICE, "right")))
        yield at, end
        at = end


def scores(docs: DataFrame, labels: DataFrame, max_texts: int = 10_000, terms=None) -> DataFrame:
    """(doc_id, source, score, flagged) of every document."""
    model = docs.sparkSession.sparkContext.broadcast(fit(prepare(*labelled(docs, labels, max_texts), terms)))  # its size follows max_texts, not the corpus

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = model.value
        for b in batches:
            texts = b.column(2)
            z = np.concatenate([s.scores(texts.slice(i, j - i)) for i, j in _slices(texts)] or [np.zeros(0)])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(z, pa.float64()), pa.array(z >= s.threshold, pa.bool_())], names=["doc_id", "source", "score", "flagged"])

    return docs.select("doc_id", "source", "text").mapInArrow(score, "doc_id long, source string, score double, flagged boolean")


def rates(scored: DataFrame) -> DataFrame:
    """Documents, flagged ones and their rate per source (spellings of one source counted together)."""
    from .mix import source_key

    out = scored.groupBy(source_key(F.col("source")).alias("source")).agg(F.count("*").alias("texts"), F.count_if("flagged").alias("flagged"), F.avg("score").alias("mean_score"))
    return out.select("source", "texts", "flagged", F.round(F.col("flagged") / F.col("texts"), 6).alias("rate"), F.round("mean_score", 6).alias("mean_score"))
