"""Repetition inside single documents, by weak supervision.

Each text is measured once: the share of words in repeated phrases, and of
characters in repeated paragraphs, lines and sentences, and how many different
words it has. Rules vote on these measures or abstain. Expectation
maximisation over the counts of vote patterns, which the number of rules
bounds, estimates how each rule votes in either class; the posterior of a
text's votes replaces a filter that all rules must pass.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.session import cut, spread

#: Words of a phrase, and the share of repeated words from which a text is repetitive.
PHRASE, SHARE = 8, 0.4
_WORD = re.compile(r"[^\W_]+")
_PARAGRAPH = re.compile(r"\r?\n[ \t]*\r?\n")
_SENTENCE = re.compile(r"(?<=[.!?。！？])\s+")
MEASURES = ("phrase_share", "paragraph_share", "line_share", "sentence_share", "distinct_share")


def words_of(text: str) -> list[str]:
    """Runs of letters and digits, in lower case."""
    return _WORD.findall(text.lower()) if text.isascii() else [w.lower() for w in _WORD.findall(text)]


def repeated_words(words: list[str], phrase: int = PHRASE) -> int:
    """How many of the words lie in ``phrase`` consecutive words that also begin at an earlier word."""
    n = len(words) - phrase + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), dtype=np.int64, count=len(words)).view(np.uint64)
    mixed = np.zeros(n, dtype=np.uint64)
    for k in range(phrase):
        mixed = (mixed ^ h[k : k + n]) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k)
        mixed ^= mixed >> np.uint64(29)
    if len(np.unique(mixed)) == n:
        return 0
    seen: dict[tuple, None] = {}
    covered = np.zeros(len(words) + 1, dtype=np.int64)
    for at in range(n):  # exact: equal hashes are only a hint
        gram = tuple(words[at : at + phrase])
        if gram in seen:
            covered[at] += 1
            covered[at + phrase] -= 1
        else:
            seen[gram] = None
    return int((np.cumsum(covered)[:-1] > 0).sum())


def _repeated_share(parts: list[str]) -> float:
    """The share of characters in parts that stood before."""
    seen, again, total = set(), 0, 0
    for p in parts:
        p = p.strip()
        if p:
            total += len(p)
            if p in seen:
                again += len(p)
            seen.add(p)
    return again / total if total else 0.0


def measure(text: str | None) -> tuple[int, float, float, float, float, float]:
    """Number of words, then the MEASURES. A null or wordless text has shares of 0 and a distinct share of 1."""
    words = words_of(text) if text else []
    if not words:
        return 0, 0.0, 0.0, 0.0, 0.0, 1.0
    return len(words), repeated_words(words) / len(words), _repeated_share(_PARAGRAPH.split(text)), _repeated_share(text.splitlines()), _repeated_share(_SENTENCE.split(text)), len(set(words)) / len(words)


def measures(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, measures) of each row; one Arrow pass, no shuffle."""
    slim = documents.select(key, text)
    schema = T.StructType([documents.schema[key], T.StructField("n_words", T.LongType()), *(T.StructField(m, T.DoubleType()) for m in MEASURES)])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                columns = list(zip(*(measure(t) for t in batch.column(1).to_pylist())))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(columns[0], pa.int64()), *(pa.array(c, pa.float64()) for c in columns[1:])], [key, "n_words", *MEASURES])

    return spread(slim).mapInArrow(walk, schema)


def rules() -> dict[str, Column]:
    """Each rule's vote: 1 repetitive, 0 not, -1 abstains."""
    vote = lambda yes, no: F.when(yes, 1).when(no, 0).otherwise(-1)
    n, share = F.col("n_words"), F.col
    return {
        "phrases": vote(share("phrase_share") >= SHARE, share("phrase_share") < SHARE / 2),
        "paragraphs": vote(share("paragraph_share") >= 0.3, (share("paragraph_share") == 0) & (share("phrase_share") == 0)),
        "lines": vote(share("line_share") >= 0.4, (share("line_share") == 0) & (share("phrase_share") == 0)),
        "sentences": vote(share("sentence_share") >= 0.4, (share("sentence_share") < 0.05) & (share("phrase_share") == 0)),
        "vocabulary": vote((n >= 50) & (share("distinct_share") < 0.15), share("distinct_share") > 0.5),
        "length": vote(F.lit(False), n <= PHRASE),
    }


def fit_label_model(patterns: dict[tuple[int, ...], int], rounds: int = 50, prior_share: float = 0.05, trust: float = 0.9, base: float = 0.05) -> tuple[float, np.ndarray, dict[tuple[int, ...], float]]:
    """(share of repetitive texts, P(vote | class) by rule, posterior by pattern) by expectation maximisation.

    Prior counts worth ``prior_share`` of the data hold that a rule which votes
    is right ``trust`` of the time and that ``base`` of all texts are
    repetitive, so that data without any repetition can't turn the classes round.
    """
    if not patterns:
        return base, np.empty((0, 2, 3)), {}
    votes = np.array(list(patterns), dtype=int) + 1
    count = np.array(list(patterns.values()), dtype=float)
    n, k = count.sum(), votes.shape[1]
    weight = max(1.0, prior_share * n)
    shown = np.array([[(count * (votes[:, r] == v)).sum() / n for v in range(3)] for r in range(k)])
    prior = np.zeros((k, 2, 3))
    for r in range(k):
        voted = max(1e-3, 1 - shown[r, 0])
        prior[r, 0] = [1 - voted, voted * trust, voted * (1 - trust)]
        prior[r, 1] = [1 - voted, voted * (1 - trust), voted * trust]
    table, share = prior.copy(), base
    post = np.zeros(len(votes))
    for _ in range(rounds):
        log = np.zeros((len(votes), 2))
        for c in range(2):
            log[:, c] = np.log(share if c else 1 - share) + sum(np.log(np.maximum(table[r, c, votes[:, r]], 1e-9)) for r in range(k))
        post = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -500, 500)))
        share = float(np.clip(((count * post).sum() + weight * base) / (n + weight), 1e-6, 1 - 1e-6))
        for c, p in enumerate((1 - post, post)):
            mass = count * p
            for r in range(k):
                seen = np.array([(mass * (votes[:, r] == v)).sum() for v in range(3)])
                table[r, c] = (seen + weight * prior[r, c] * (base if c else 1 - base)) / (mass.sum() + weight * (base if c else 1 - base))
    return share, table, dict(zip(patterns, post.tolist()))


def repetition(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, measures, posterior) of each row.

    ``phrase_share`` is the share of repeated words, ``posterior`` the
    probability that the text is repetitive. Null, empty and wordless texts
    have shares of 0 and vote accordingly. The texts are read once; the vote
    patterns that come to the driver are 3^6 at most.
    """
    votes = rules()
    voted = cut(measures(documents, key, text).withColumns({f"v_{r}": v.cast("int") for r, v in votes.items()}))
    names = [f"v_{r}" for r in votes]
    patterns = {tuple(r[c] for c in names): r["n"] for r in voted.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).collect()}
    _, _, posterior = fit_label_model(dict(sorted(patterns.items())))
    rows = [(*p, x) for p, x in posterior.items()]
    known = documents.sparkSession.createDataFrame(rows, ", ".join([*(f"{c} int" for c in names), "posterior double"]))
    return voted.join(F.broadcast(known), names).select(key, "n_words", *MEASURES, "posterior")


def found_repetitive(documents: DataFrame) -> DataFrame:
    """Distinct doc_id of the texts that the label model holds repetitive and whose exact share is 0.4 or more."""
    return repetition(documents).filter((F.col("posterior") >= 0.5) & (F.col("phrase_share") >= SHARE)).select("doc_id").distinct()
