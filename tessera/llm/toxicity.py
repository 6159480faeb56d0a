"""Toxicity by a noisy-channel reading of obfuscated text.

A segment that looks disguised (letters swapped for digits or signs, letters set apart, letters drawn out) is a
lattice of characters; Viterbi decoding under a character trigram model of the whole corpus restores it. The
restored text is scored by a logistic regression over words that labelled rows tell apart."""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import hash_below, limit_batches, map_texts

#: Labelled rows, about, that the classifier is fitted on, and words it may use.
SAMPLE_ROWS, LEXICON = 8000, 400
#: Readings of runs up to this many characters are remembered; after so many steps a decoder drops what is settled.
REMEMBERED, SETTLE = 64, 512
#: Bytes of a text that are counted at a time.
PIECE = 1 << 18

#: What a sign may stand for.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t"}
_SIGNS = "0-9@$!|+"
_mixed = re.compile(rf"(?<![a-z{_SIGNS}])[a-z]*+[{_SIGNS}][a-z{_SIGNS}]*+").finditer
_drawn_out = re.compile(r"([a-z])\1\1").search
_long_words = re.compile(r"[a-z]+").finditer
_apart = re.compile(rf"(?<![a-z{_SIGNS}])[a-z{_SIGNS}](?:[ ._*-]{{1,3}}[a-z{_SIGNS}](?![a-z{_SIGNS}])){{2,}}").finditer
_letters = re.compile(r"[a-z]{2,}").fullmatch
_words = re.compile(r"[^\W\d_]+").findall

_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[ord("a") : ord("z") + 1] = np.arange(1, 27)


def trigram_counts(docs: DataFrame) -> np.ndarray:
    """Counts (27, 27, 27) of letter trigrams over the whole texts of all rows; 0 is whatever is no letter.

    A text is counted in pieces of PIECE characters, so a very long one takes no more memory than its bytes."""
    limit_batches(docs.sparkSession)

    def count(batches):
        import pyarrow as pa

        total = np.zeros(27**3, np.int64)
        for batch in batches:
            for text in batch.column(0):
                symbols = np.frombuffer(f"  {text.as_py().lower()}  ".encode("utf-8", "surrogatepass"), np.uint8)
                for i in range(0, len(symbols) - 2, PIECE):
                    s = _SYMBOL[symbols[i : i + PIECE + 2]]
                    total += np.bincount(s[:-2] * 729 + s[1:-1] * 27 + s[2:], minlength=27**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["gram", "n"])

    grams = docs.select("text").where("text is not null").mapInArrow(count, "gram long, n long")
    out = np.zeros(27**3)
    for r in grams.groupBy("gram").agg(F.sum("n").alias("n")).collect():  # at most 27 ** 3 rows
        out[r["gram"]] = r["n"]
    return out.reshape(27, 27, 27)


@dataclass
class Channel:
    """Log-probabilities of a letter after two others, and the decoder over them."""

    logp: list
    seen: dict[str, str] = field(default_factory=dict)

    @classmethod
    def of(cls, counts: np.ndarray) -> Channel:
        one = counts.sum((0, 1)) + 1
        two = counts.sum(0) + 0.5 * (one / one.sum())
        two /= two.sum(1, keepdims=True)
        three = counts + 2.0 * two[None]
        return cls(np.log(three / three.sum(2, keepdims=True)).tolist())

    def __getstate__(self):
        return {"logp": self.logp, "seen": {}}

    def lattice(self, text: str) -> list[list[tuple[str, float]]]:
        """For each character what it may have been, with the cost of that."""
        out = []
        for m in re.finditer(r"(.)\1*", text, re.S):
            c, n = m[1], m.end() - m.start()
            if c in " ._*-":
                out.append([("", -0.5 * n), (" ", -3.0 / n)])
                continue
            for i in range(n):
                options = [(x, -1.0) for x in LEET.get(c, "")] if not c.isalpha() else [(c, 0.0)]
                if not c.isalpha():
                    options.append(("", -9.0))
                elif n > 2 and i:
                    options = [(c, -1.5), ("", -0.3)]
                out.append(options)
        return out

    def decode(self, text: str) -> str:
        """The likeliest reading of a segment, by Viterbi over states of the last two symbols."""
        if text in self.seen:
            return self.seen[text]
        logp = self.logp
        best: dict[tuple[int, int], float] = {(0, 0): 0.0}
        said, steps = [], []
        for options in self.lattice(text):
            now: dict[tuple[int, int], float] = {}
            back: dict[tuple[int, int], tuple[tuple[int, int], str]] = {}
            for (p, q), score in best.items():
                row = logp[p][q]
                for x, cost in options:
                    if x:
                        k = ord(x) - 96 if x != " " else 0
                        to, s = (q, k), score + cost + row[k]
                    else:
                        to, s = (p, q), score + cost
                    if to not in now or s > now[to]:
                        now[to], back[to] = s, ((p, q), x)
            best = now
            steps.append(back)
            if len(steps) % SETTLE == 0:
                said.append(self.settled(best, steps))
        end = max((s + logp[p][q][0], (p, q)) for (p, q), s in best.items())[1]
        said.append(self.settled([end], steps))
        out = "".join(said)
        if len(text) <= REMEMBERED:
            if len(self.seen) > 100_000:
                self.seen.clear()
            self.seen[text] = out
        return out

    @staticmethod
    def settled(ends, steps: list[dict]) -> str:
        """What all paths to ``ends`` have in common at their beginning; ``steps`` keeps the rest."""
        at, n = set(ends), len(steps)
        while n and len(at) > 1:
            n -= 1
            at = {steps[n][e][0] for e in at}
        if len(at) > 1:
            return ""
        here, out = at.pop(), []
        for back in reversed(steps[:n]):
            here, x = back[here]
            out.append(x)
        del steps[:n]
        return "".join(reversed(out))

    def likely(self, word: str) -> bool:
        """Whether a word is likelier, letter by letter, than one of letters drawn at random."""
        at = [0, 0, *(ord(x) - 96 for x in word), 0]
        return sum(self.logp[p][q][k] for p, q, k in zip(at, at[1:], at[2:])) > (len(word) + 1) * np.log(1 / 27)

    def readings(self, text: str, core: str | None) -> str:
        """How a disguised segment reads; both ways if its last signs (behind ``core``) may be letters or not."""
        said = self.decode(text)
        if len(re.findall("[a-z]", text)) < 2 and not (said.isalpha() and self.likely(said)):
            said = text
        if core is None:
            return said
        short = self.decode(core) if not core.isalpha() and re.search("[a-z].*[a-z]", core) else core
        return said if short in ("", said) else f"{said} {short}"

    def restore(self, text: str) -> str:
        """The lower-cased text with its disguised segments read plainly."""
        text = text.lower()
        spans, ends = [], {}
        for m in _mixed(text):
            core, whole = m[0].rstrip("$!|+@"), m[0].rstrip("!|")
            if not whole.isalpha() and re.search("[a-z]", whole):
                spans.append((m.start(), m.start() + len(whole)))
                if whole != core:
                    ends[spans[-1]] = core
        for m in _apart(text):
            spans.append(m.span())
        if _drawn_out(text):
            spans += [m.span() for m in _long_words(text) if _drawn_out(m[0])]
        if not spans:
            return text
        out, at = [], 0
        for a, b in sorted(spans):
            if a >= at:
                out += [text[at:a], self.readings(text[a:b], ends.get((a, b)))]
                at = b
        return "".join([*out, text[at:]])


@dataclass
class Model:
    channel: Channel
    words: dict[str, int]
    weights: np.ndarray
    bias: float

    def scores(self, texts: list[str | None]) -> list[float]:
        known = self.words.keys()
        out = []
        for text in texts:
            found = known & set(_words(self.channel.restore(text))) if text else ()
            z = self.bias + sum(float(self.weights[self.words[w]]) for w in sorted(found))
            out.append(float(1 / (1 + np.exp(-np.clip(z, -30, 30)))))
        return out


def regress(rows: list[list[int]], y: np.ndarray, width: int, steps: int = 400, ridge: float = 2e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on sets of feature indexes, by gradient descent with momentum."""
    x = np.zeros((len(rows), width), np.float32)
    for i, r in enumerate(rows):
        x[i, r] = 1
    w, b = np.zeros(width), float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    vw, vb = np.zeros(width), 0.0
    for _ in range(steps):
        g = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30))) - y
        vw, vb = 0.9 * vw + (x.T @ g / len(y) + ridge * w), 0.9 * vb + g.mean()
        w, b = w - 4.0 * vw, b - 1.0 * vb
    return w, b


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, lexicon: int = LEXICON) -> Model:
    """Learn from ``labels`` (doc_id, toxic): the character model from all of ``docs``, the words and weights from about ``rows`` labelled rows.

    The sample is of rows with the smallest hashes, equal texts once, the same on each run. A word counts if it
    is in at least three texts and likelier in toxic ones."""
    channel = Channel.of(trigram_counts(docs))
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = known.count()
    sampled = hash_below(F.xxhash64(F.lit("sample"), "doc_id"), rows / max(1, n))
    joined = docs.select("doc_id", "text").where("text is not null").where(sampled).join(known.where(sampled), "doc_id")

    def make():
        return lambda texts: (None, {"words": [sorted(set(_words(channel.restore(t)))) for t in texts]})

    bags = map_texts(joined.withColumn("copy", F.xxhash64("text")), ["copy", "toxic"], make, "words array<string>")
    bags = bags.groupBy("copy").agg(F.max("toxic").alias("toxic"), F.first("words").alias("words")).persist()
    size = {r["toxic"]: r["count"] for r in bags.groupBy("toxic").count().collect()}
    toxic, clean = size.get(1, 0), size.get(0, 0)
    by_word = bags.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(F.sum(F.expr("int(toxic = 1)")).alias("t"), F.sum(F.expr("int(toxic = 0)")).alias("c"))
    lift = F.log((F.col("t") + 0.5) / (toxic + 1)) - F.log((F.col("c") + 0.5) / (clean + 1))
    top = by_word.where((F.col("t") >= 3) & (lift > 1)).orderBy((F.col("t") * lift).desc(), "word").limit(lexicon)
    words = {r["word"]: i for i, r in enumerate(top.select("word").collect())}
    picked = F.array_intersect("words", F.array(*[F.lit(w) for w in words])) if words else F.array().cast("array<string>")
    found: dict[tuple, int] = defaultdict(int)
    for r in bags.select("toxic", picked.alias("words")).collect():  # a bounded sample, at most ``lexicon`` words each
        found[(tuple(sorted(words[w] for w in r["words"])), int(r["toxic"] == 1))] += 1
    bags.unpersist()
    sets = [list(k[0]) for k, c in sorted(found.items()) for _ in range(c)]
    y = np.array([k[1] for k, c in sorted(found.items()) for _ in range(c)], float)
    if not len(y):
        return Model(channel, {}, np.zeros(0), -30.0)
    weights, bias = regress(sets, y, len(words))
    return Model(channel, words, weights, bias)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1, higher: likelier toxic) of every row.

    Null and empty texts get the score of a text without a telling word; repeated rows are scored each; without
    a labelled row all scores are next to 0. Other columns, of whatever names, are no input."""

    def make():
        return lambda texts: (None, {"score": model.scores(texts)})

    return map_texts(docs, ["doc_id"], make, "score double")
