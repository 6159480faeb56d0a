"""Secret scans: fixed patterns, and character Markov models of random strings and ordinary identifiers.

A token that is much likelier under the model of random strings than under that of ordinary identifiers is a
secret. Both models are first-order chains, trained from labelled samples."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import free_names, hash_below, map_texts, with_text_column

KINDS = ("assign", "access", "hex", "markov")
#: Rows of documents, about, whose ordinary tokens and known secrets train the models, and tokens of either sort at most.
SAMPLE_ROWS, SAMPLE_TOKENS = 2000, 20_000
#: Shortest token judged by the models, and strings made up for each kind of random string.
SHORTEST, MADE_UP = 16, 400
#: Characters of a sampled token that are learned from; nats a character that a secret is likelier as a random string.
LONG, RATE = 200, 1.4

_assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A).finditer
_keys = re.compile("(?i:passw|secret|token|api_?key)", re.A).search
_access = re.compile(r"AKIA[A-Z0-9]+").finditer
_hex = re.compile(r"[0-9a-f]{24,}").finditer  # of a run of hex digits all or nothing is taken
_token = re.compile(rf"[A-Za-z0-9+/_=-]{{{SHORTEST},}}").finditer
_word = re.compile(r"[A-Za-z][A-Za-z0-9]*").findall

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_AT = np.full(128, len(ALPHABET), np.int64)
_AT[[ord(c) for c in ALPHABET]] = np.arange(len(ALPHABET))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of what the fixed patterns find, sorted by start, then by kind as listed."""
    found = []
    if _keys(text):
        found += [(*m.span(), "assign") for m in _assign(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(*m.span(), "access") for m in _access(text) if m.end() - m.start() >= 20]
    found += [(*m.span(), "hex") for m in _hex(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def steps(tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all tokens in a row and the symbols before them; the one before a token's first is the start."""
    x = _AT[np.frombuffer("".join(tokens).encode("ascii"), np.uint8)]
    before = np.empty_like(x)
    before[1:] = x[:-1]
    before[np.cumsum([0, *map(len, tokens[:-1])])[: len(tokens)]] = len(ALPHABET)
    return before, x


class Chain:
    """First-order Markov chain over ALPHABET and a symbol for the start."""

    def __init__(self, samples: list[str]):
        n = len(ALPHABET) + 1
        before, x = steps([s for s in samples if s])
        counts = 0.05 + np.bincount(before * n + x, minlength=n * n).reshape(n, n)
        self.logp = np.log(counts / counts.sum(1, keepdims=True))


def random_strings(seed: int = 11) -> list[str]:
    """Made-up samples of random strings: hex, base 32, base 64 (both alphabets) and letters with digits, of many lengths."""
    rng = np.random.default_rng(seed)
    alphabets = ["0123456789abcdef", ALPHABET[:26] + "234567", ALPHABET[:62] + "+/", ALPHABET[:62] + "_-", ALPHABET[:62], ALPHABET[26:62]]
    return ["".join(rng.choice(list(a), rng.integers(16, 48))) for a in alphabets for _ in range(MADE_UP)]


def ordinary_strings(words: list[str], seed: int = 12) -> list[str]:
    """Identifiers made of words: as they stand, in snake, kebab and camel case, as paths, and with numbers; rulers too."""
    rng = np.random.default_rng(seed)
    out = list(words)
    for _ in range(len(words)):
        some = [words[i] for i in rng.integers(0, len(words), rng.integers(2, 5))]
        low = [w.lower() for w in some]
        out += ["_".join(low), "-".join(low), "/".join(low), "".join(w.title() for w in some), "_".join(low).upper(), low[0] + str(rng.integers(1, 10**6))]
    out += [str(rng.integers(0, 10**12)) * int(rng.integers(1, 3)) for _ in range(len(words) // 4)]
    # rulers and alphabets
    out += [c * int(n) for c in "-_=+/" for n in rng.integers(SHORTEST, 80, 40)]
    return out + [a * 2 for a in (ALPHABET[:26], ALPHABET[26:52], ALPHABET[52:62])] * 40


class Scanner:
    """The two chains as one table of log-likelihood ratios, and the bound above which a token is a secret."""

    def __init__(self, secrets: list[str], words: list[str]):
        random, ordinary = random_strings() + secrets, ordinary_strings(words)
        self.ratio = Chain(random).logp - Chain(ordinary).logp
        scores = self.ratios([s for s in ordinary if len(s) >= SHORTEST])
        # at least 8 nats, and above all but one of ten thousand ordinary identifiers
        self.bound = max(8.0, float(np.quantile(scores, 0.9999)) if len(scores) else 0.0)

    def ratios(self, tokens: list[str]) -> np.ndarray:
        if not tokens:
            return np.zeros(0)
        before, x = steps(tokens)
        return np.add.reduceat(self.ratio[before, x], np.cumsum([0, *map(len, tokens[:-1])]))

    def scan(self, texts: list[str]) -> list[list[tuple[int, int, str]]]:
        """Spans of every text: the fixed patterns' and, apart from those, the models'."""
        all_spans = [base_spans(t) for t in texts]
        where, tokens = [], []
        for i, t in enumerate(texts):
            for m in _token(t):
                a, b = m.span()
                if not m[0].isdigit() and not any(s < b and a < e for s, e, _ in all_spans[i]):
                    where.append((i, a, b))
                    tokens.append(m[0])
        for (i, a, b), r in zip(where, self.ratios(tokens)):
            if r > self.bound and r > RATE * (b - a):
                all_spans[i].append((a, b, "markov"))
        return [sorted(s, key=lambda x: (x[0], KINDS.index(x[2]))) for s in all_spans]


def fit(docs: DataFrame, rows: int = SAMPLE_ROWS) -> Scanner:
    """Train on about ``rows`` rows, those with the smallest hashes: what the fixed patterns find in them are labelled
    secrets, up to 50 words of the rest of each are ordinary; at most SAMPLE_TOKENS of either, those with the smallest hashes.

    Without a text, or with short ones alone, the models learn from the made-up strings and what words there are."""
    some = docs.select("doc_id", "text").where("text is not null")
    some = some.where(hash_below(F.xxhash64(F.lit("sample"), "doc_id", "text"), rows / max(1, docs.count())))

    def make():
        def call(texts):
            rows, out = [], {"secret": [], "token": []}
            for i, text in enumerate(texts):
                spans, at, rest = base_spans(text), 0, []
                for a, b, kind in spans:
                    rest.append(text[at:a])
                    at = max(at, b)
                    value = re.split(r"[:=\"' ]+", text[a:b].rstrip("="))[-1] if kind == "assign" else text[a:b]
                    if len(value) >= SHORTEST and set(value) <= set(ALPHABET):
                        rows.append(i)
                        out["secret"].append(True)
                        out["token"].append(value[:LONG])
                words = _word(" ".join([*rest, text[at:]]))
                step = max(1, len(words) // 50)
                for w in words[::step][:50]:
                    rows.append(i)
                    out["secret"].append(False)
                    out["token"].append(w[:LONG])
            return rows, out

        return call

    tokens = map_texts(some, [], make, "secret boolean, token string").distinct()
    least = F.row_number().over(Window.partitionBy("secret").orderBy(F.xxhash64("token"), "token"))
    found = tokens.withColumn("nth", least).where(F.col("nth") <= SAMPLE_TOKENS).orderBy("secret", "token").collect()  # 2 * SAMPLE_TOKENS rows of LONG characters at most
    return Scanner([r["token"] for r in found if r["secret"]], [r["token"] for r in found if not r["secret"]])


def scan(docs: DataFrame, scanner: Scanner) -> DataFrame:
    """doc_id and spans (array of start, end, kind; code points, end exclusive) of every row of ``docs``.

    Null texts count as empty and have no spans; repeated rows are scanned each; other columns are no input."""

    def make():
        def call(texts):
            found = scanner.scan([t or "" for t in texts])
            return None, {"spans": [[{"start": a, "end": b, "kind": k} for a, b, k in s] for s in found]}

        return call

    return map_texts(docs, ["doc_id"], make, "spans array<struct<start:int,end:int,kind:string>>")


def redact_text(text: str, spans: list[tuple[int, int, str]], mark: str = "[SECRET]") -> str:
    out, at = [], 0
    for a, b, _ in spans:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, scanner: Scanner) -> DataFrame:
    """The rows of ``docs`` with every secret replaced by a mark; overlapping spans get one. All columns are kept,
    whatever their names, and n_chars, if there is one, follows the text.

    Null and empty texts stay as they are; repeated rows are redacted each; no rows give no rows."""

    def call(texts):
        return [t if not s else redact_text(t, s) for t, s in zip(texts, scanner.scan([t or "" for t in texts]))]

    (made,) = free_names(docs, "clean")
    clean = with_text_column(docs, made, lambda: call, "string").withColumn("text", F.col(made))
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(dict(docs.dtypes)["n_chars"])))
    return clean.select(*docs.columns)
