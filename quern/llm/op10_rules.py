"""Quality rules by weak supervision.

Each rule reads one measure of a text and votes good, votes bad or abstains. Vote patterns
are counted over all documents (there are at most 3 ** len(RULES) of them, whatever the
corpus), expectation-maximisation over these counts estimates every rule's accuracy on good
and on bad texts and the share of good ones, and a document is kept when the posterior
probability that it is good reaches ``threshold``. A rule that fires no longer rejects a text
by itself.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import chunks, materialize, shingle_hashes, table, texts, word_hashes

SYMBOLS = b"#*$%&|<>"
_SPACE = b" \t\n\r\x0b\x0c"
_CONTINUATION = bytes(range(0x80, 0xC0))
#: Frequent words of the four languages; fixed values.
STOP = frozenset(b"the of and to in that is it for on with as was are der die und das von den mit zu ist nicht des auf la de le et les que un elle des est pour el en los se del por con no una para".split())
ENDS = (b".", b"!", b"?", b'"', b":", b";")
LONGS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_ended", "n_upper", "n_stop", "n_marks", "n_stutter")


def repeat_words(hashes: np.ndarray, k: int = 8) -> int:
    """Words inside k-word windows that occur twice or more."""
    if len(hashes) < k + 1:
        return 0
    windows = shingle_hashes(hashes, k)
    _, back, count = np.unique(windows, return_inverse=True, return_counts=True)
    if len(count) == len(windows):
        return 0
    at = np.flatnonzero(count[back] > 1)
    change = np.zeros(len(hashes) + 1, np.int32)
    np.add.at(change, at, 1)
    np.add.at(change, at + k, -1)
    return int(np.count_nonzero(np.cumsum(change)[:-1]))


def measures(text: bytes) -> tuple:
    words = text.split()
    seen, dup, lines, ended = set(), 0, 0, 0
    for line in text.split(b"\n"):
        if not line.strip(_SPACE):
            continue
        lines += 1
        ended += line.rstrip(_SPACE).endswith(ENDS)
        if line in seen:
            dup += 1
        else:
            seen.add(line)
    bare = text.translate(None, _SPACE + _CONTINUATION)
    symbols = len(bare) - len(bare.translate(None, SYMBOLS))
    marks = sum(map(words.count, (b"|", b"-", b"*")))
    upper = sum(map(bytes.isupper, words))
    stop = sum(map(STOP.__contains__, words))
    stutter = sum(map(bytes.__eq__, words[1:], words))
    return len(words), len(bare), symbols, dup, repeat_words(word_hashes(words)), lines, ended, upper, stop, marks, stutter


def measured(docs: DataFrame) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in LONGS)])

    def run(batches):
        for b in chunks(batches):
            rows = [measures(t) for t in texts(b)]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in zip(*rows, strict=True))], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in LONGS))


def _ratio(a: str, b: str):
    return F.col(a) / F.greatest(F.col(b), F.lit(1))


def _vote(good, bad):
    """1 good, 2 bad, 0 abstains."""
    return F.when(bad, 2).when(good, 1).otherwise(0)


def rules() -> dict:
    length, symbol, dup = _ratio("word_chars", "n_words"), _ratio("n_symbols", "word_chars"), _ratio("n_dup_lines", "n_lines")
    repeat, upper, stop, marks, stutter = (_ratio(c, "n_words") for c in ("n_repeat_words", "n_upper", "n_stop", "n_marks", "n_stutter"))
    ended = _ratio("n_ended", "n_lines")
    return {
        "word_length": _vote((length >= 3) & (length <= 10), (length < 2) | (length > 16)),
        "symbols": _vote(symbol < 0.01, symbol > 0.08),
        "duplicate_lines": _vote((F.col("n_lines") >= 3) & (dup < 0.05), dup > 0.3),
        "repeated_windows": _vote((F.col("n_words") >= 50) & (repeat < 0.1), repeat > 0.2),
        "length": _vote(F.col("n_words") >= 60, F.col("n_words") < 25),
        "sentence_ends": _vote(ended >= 0.8, ended < 0.3),
        "capitals": _vote(upper < 0.1, upper > 0.3),
        "stop_words": _vote(stop >= 0.08, stop < 0.005),
        "list_marks": _vote(marks < 0.02, marks > 0.1),
        "stutter": _vote((F.col("n_words") >= 20) & (stutter < 0.1), stutter > 0.3),
    }


def fit(votes: np.ndarray, counts: np.ndarray, steps: int = 200) -> tuple[np.ndarray, float, np.ndarray]:
    """Accuracies (rule x [on good, on bad]), share of good texts, posterior of each pattern.

    votes: patterns x rules of 0, 1, 2. Abstaining tells nothing. A rule that votes good on bad
    texts as often as on good ones ends with no weight. Starts from texts with no vote for bad
    as good and texts with two as bad, which also tells the two classes apart."""
    good, bad = votes == 1, votes == 2
    n = counts.astype(float)
    post = np.array([0.9, 0.5, 0.1])[np.minimum(bad.sum(1), 2)]
    acc, prior = np.full((votes.shape[1], 2), 0.8), 0.8
    for _ in range(steps):
        for side, (hit, miss, p) in enumerate(((good, bad, post), (bad, good, 1 - post))):
            right, wrong = (n * p) @ hit, (n * p) @ miss
            acc[:, side] = np.clip((right + 1) / (right + wrong + 2), 0.005, 0.995)
        prior = float(np.clip((n @ post) / max(n.sum(), 1), 0.02, 0.98))
        log = np.log(prior / (1 - prior)) + good @ np.log(acc[:, 0] / (1 - acc[:, 1])) + bad @ np.log((1 - acc[:, 0]) / acc[:, 1])
        now = 1 / (1 + np.exp(-np.clip(log, -40, 40)))
        if np.abs(now - post).max(initial=0) < 1e-9:
            break
        post = now
    return acc, prior, post


def judge(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row per row of docs (doc_id, text): the measures, the posterior, base_failed, kept.

    A null text has no words and fails the base rules, as an empty one. All of a very long text
    is measured. Equal texts have equal measures, votes and posteriors; a posterior equal to
    the threshold is kept. doc_id may be null or repeated; further columns are ignored; no rows
    give no rows.
    """
    spark = docs.sparkSession
    votes = rules()
    pattern = sum((v * F.lit(3**i) for i, v in enumerate(votes.values())), F.lit(0)).cast("long")
    seen = materialize(measured(docs).withColumn("pattern", pattern), "rules")
    counted = seen.groupBy("pattern").count().collect()  # at most 3 ** len(votes) rows
    codes = np.array([r["pattern"] for r in counted], np.int64)
    digits = (codes[:, None] // 3 ** np.arange(len(votes))) % 3 if len(codes) else np.zeros((0, len(votes)), np.int64)
    _, _, post = fit(digits, np.array([r["count"] for r in counted]))
    known = spark.createDataFrame([(int(c), float(p)) for c, p in zip(codes, post, strict=True)], "pattern long, posterior double")
    n = F.col("n_words")
    failed = (n < 20) | (100 * F.col("n_repeat_words") > 30 * n)
    out = seen.join(F.broadcast(known), "pattern").withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))


def op10_rules(spark, sf_dir: str) -> DataFrame:
    out = judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")
