"""Language identification by multilingual mixture inference.

A text is taken as a mixture of languages.  Hashed character trigrams give each
language's likelihood; expectation-maximisation estimates a text's language
proportions, and the language set is the one with the best penalised
likelihood (each further language costs half the log of the trigram count, as
in BIC, times ``PENALTY``).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import _process_cache, fresh, release, small_batches

#: Hashed trigram buckets: the model is languages x BUCKETS floats, whatever the corpus.
BUCKETS = 1 << 15
SMOOTHING, PENALTY, ROUNDS = 0.5, 4.0, 12
UNDETERMINED = "und"


def _letters() -> np.ndarray:
    cache = _process_cache()
    if not hasattr(cache, "letters"):
        cache.letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return cache.letters


def trigrams(text: str | None) -> np.ndarray:
    """Bucket of every trigram of the lower-cased whole text.

    Runs of anything but letters count as one space; a text without letters
    has no trigrams.
    """
    if not text:
        return np.zeros(0, np.uint32)
    cp = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[cp]
    if not letter.any():
        return np.zeros(0, np.uint32)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[0] = True
    cp = np.where(letter, cp, np.uint32(32))[keep].astype(np.uint32)
    h = cp[:-2] * np.uint32(0x9E3779B1) ^ cp[1:-1] * np.uint32(0x85EBCA77) ^ cp[2:] * np.uint32(0xC2B2AE3D)
    h ^= h >> np.uint32(15)
    return (h * np.uint32(0x2C1B3C6D)) >> np.uint32(17)


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang"):
    """Log-likelihood table of every language in ``docs``: (names, matrix).

    Rows with a null language or text are left out; repeated rows count each; texts
    may be of any length; no rows make a model without languages.
    Counts cover all rows; what comes to the driver is at most languages x
    BUCKETS sums, as Arrow columns of 12 bytes a sum.
    """

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for at in range(0, b.num_rows, 1_000):
                part = b.slice(at, 1_000)
                for text, lang in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    if (g := trigrams(text)).size:
                        total = sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
                        np.add(total, np.bincount(g, minlength=BUCKETS), out=total)
            release()
        for lang, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict(
                {"lang": pa.array([lang] * len(at), pa.string()), "bucket": at.astype(np.int32), "n": total[at]}
            )

    small_batches(docs.sparkSession)
    rows = (
        docs.select(F.col(text_col), F.col(lang_col))
        .where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
        .mapInArrow(count, "lang string, bucket int, n long")
        .groupBy("lang", "bucket")
        .agg(F.sum("n").alias("n"))
    )
    got = rows.toArrow().combine_chunks()
    lang = got.column("lang").combine_chunks().dictionary_encode() if got.num_rows else pa.array([], pa.string()).dictionary_encode()
    found = lang.dictionary.to_pylist()
    names = sorted(found)
    table = np.full((BUCKETS, len(names)), SMOOTHING, np.float64)
    if names:
        column = np.array([names.index(x) for x in found])[lang.indices.to_numpy()]
        table[got.column("bucket").to_numpy(), column] += got.column("n").to_numpy()
    return names, (table / table.sum(axis=0, keepdims=True)).astype(np.float32)


def _mixture(p: np.ndarray, c: np.ndarray, rounds: int = ROUNDS):
    """EM proportions of the columns of ``p`` and the log-likelihood."""
    total, pi = c.sum(), np.full(p.shape[1], 1.0 / p.shape[1])
    for _ in range(rounds):
        r = p * pi
        s = r.sum(axis=1)
        pi = (c / s) @ r / total
    return pi, float(c @ np.log(p @ pi))


def infer(g: np.ndarray, table: np.ndarray):
    """(language set as columns, proportions within it, score of the first)."""
    counts = np.bincount(g, minlength=BUCKETS)
    at = np.flatnonzero(counts)
    c, p = counts[at].astype(np.float64), table[at].astype(np.float64)
    total = c.sum()
    pi, _ = _mixture(p, c)
    single = c @ np.log(p)
    first = int(np.argmax(single))
    order = [first, *[int(x) for x in np.argsort(-pi, kind="stable") if x != first]]
    cost = PENALTY * 0.5 * np.log(total + 1)
    best = ([first], np.ones(1), float(single[first]) - cost)
    # The set grows, largest share first, until a further language no longer pays.
    for m in range(2, len(order) + 1):
        if pi[order[m - 1]] * total < 1:
            break
        w, ll = _mixture(p[:, order[:m]], c)
        if ll - m * cost <= best[2]:
            break
        best = (order[:m], w, ll - m * cost)
    chosen, w, _ = best
    rank = sorted(range(len(chosen)), key=lambda i: (-w[i], chosen[i]))
    chosen, w = [chosen[i] for i in rank], w[rank]
    # The full mixture's share with one pseudo-count per language.
    score = (pi[chosen[0]] * total + 1) / (total + table.shape[1])
    return chosen, w, float(min(1.0, max(0.0, score)))


def guess(model, text: Column) -> Column:
    """struct(lang_pred, score, lang_set, lang_share) of a text.

    A null text, one without letters, and any text when no language was
    learned give ``und``, score 0 and empty arrays.  Whole texts of any length count; equally
    likely languages go by name; equal texts give equal results.
    """
    names, table = model
    kind = "lang_pred string, score double, lang_set array<string>, lang_share array<double>"

    def run(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            g = trigrams(t)
            if not g.size or not names:
                out.append((UNDETERMINED, 0.0, [], []))
                continue
            chosen, w, score = infer(g, table)
            out.append((names[chosen[0]], score, [names[i] for i in chosen], [float(x) for x in w]))
        release()
        return pd.DataFrame(out, columns=["lang_pred", "score", "lang_set", "lang_share"])

    # Costly: not to be worked out once for a filter and again for the columns behind it.
    return F.pandas_udf(run, kind).asNondeterministic()(text)


def predict(docs: DataFrame, model, text_col: str = "text") -> DataFrame:
    """``docs`` with the fields of ``guess`` as columns; columns of those names are replaced; an empty table gives no rows."""
    made = ("lang_pred", "score", "lang_set", "lang_share")
    keep = [F.col(f"`{c}`") for c in docs.columns if c not in made]
    (g,) = fresh(docs, "_guess")
    return docs.withColumn(g, guess(model, F.col(text_col))).select(*keep, f"{g}.*")


def held_out(doc_id: str = "doc_id", folds: int = 5):
    """True for the documents that training never sees (null ids included)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == 0, F.lit(True))
